"""Raw files before they are read: where they lie, fetching them, unpacking them.

These helpers prepare a folder on the driver's side; everything after them reads with Spark.
"""

from __future__ import annotations

import gzip
import os
import shutil
import tarfile
import urllib.request
from pathlib import Path


def first_existing(candidates: list[str]) -> str:
    """The first of several paths that exists; the error names them all."""
    for c in candidates:
        if os.path.exists(c):
            return c
    raise FileNotFoundError("none of these exists: " + ", ".join(candidates))


def download(url: str, target: str, size: int | None = None, chunk: int = 1 << 20) -> int:
    """Fetch a file, going on where an earlier try stopped; the size found must be ``size``.

    A complete file is not fetched again. A server that does not answer with the part asked
    for begins anew. Returns the number of bytes in the file.
    """
    partial = Path(target + ".part")
    if size is not None and os.path.exists(target) and os.path.getsize(target) == size:
        return size
    have = partial.stat().st_size if partial.exists() else 0
    if size is not None and have > size:
        partial.unlink()
        have = 0
    if size is None or have < size:
        request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
        with urllib.request.urlopen(request) as source:
            goes_on = have > 0 and source.status == 206
            with open(partial, "ab" if goes_on else "wb") as out:
                shutil.copyfileobj(source, out, chunk)
    found = partial.stat().st_size
    if size is not None and found != size:
        raise OSError(f"{url}: {found} bytes, expected {size}; run again to go on")
    os.replace(partial, target)
    return found


def unpack(path: str, folder: str) -> list[str]:
    """Files of a tar archive or the content of a gzip file, written into a folder."""
    os.makedirs(folder, exist_ok=True)
    if tarfile.is_tarfile(path):
        with tarfile.open(path) as archive:
            archive.extractall(folder, filter="data")
            return sorted(os.path.join(folder, m.name) for m in archive.getmembers() if m.isfile())
    target = os.path.join(folder, os.path.basename(path).removesuffix(".gz"))
    with gzip.open(path, "rb") as source, open(target + ".part", "wb") as out:
        shutil.copyfileobj(source, out)
    os.replace(target + ".part", target)
    return [target]


def share(path: str, other: str) -> None:
    """Let one file be found under two paths, as a link where the file system allows it."""
    if os.path.exists(other):
        return
    os.makedirs(os.path.dirname(other) or ".", exist_ok=True)
    try:
        os.link(path, other)
    except OSError:
        shutil.copyfile(path, other)
