"""Ordered stages with stale checks, so a run repeats only what its inputs changed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    """A named step from input tables to one output table."""

    name: str
    build: Callable[..., DataFrame]
    inputs: tuple[str, ...] = ()
    output: str = ""
    needs: tuple[str, ...] = field(default=())


def _modified(spark: SparkSession, path: str) -> int | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else None


def plan(spark: SparkSession, stages: list[Stage], only: set[str] | None = None, start: str | None = None, force: bool = False) -> list[tuple[str, bool, str]]:
    """``(stage, run, reason)`` for each stage, without running anything."""
    out, changed, begun = [], set(), start is None
    for s in stages:
        begun = begun or s.name == start
        missing = [i for i in s.inputs if _modified(spark, i) is None and not any(i == t.output for t in stages)]
        made = _modified(spark, s.output)
        if missing:
            decision = (False, "missing input " + ", ".join(missing))
        elif only is not None and s.name not in only or not begun:
            decision = (False, "not asked for")
        elif force:
            decision = (True, "forced")
        elif made is None:
            decision = (True, "no output")
        elif any(i in changed or (_modified(spark, i) or 0) > made for i in s.inputs):
            decision = (True, "newer input")
        else:
            decision = (False, "up to date")
        if decision[0]:
            changed.add(s.output)
        out.append((s.name, *decision))
    return out


def run(spark: SparkSession, stages: list[Stage], **choice) -> list[tuple[str, bool, str]]:
    """Run what :func:`plan` decides, in order; a failing stage stops the run."""
    decided = plan(spark, stages, **choice)
    by_name = {s.name: s for s in stages}
    for name, wanted, _ in decided:
        if wanted:
            s = by_name[name]
            for need in s.needs:
                if _modified(spark, need) is None:
                    raise ValueError(f"{name} needs {need}; run the stage that makes it first")
            s.build(*[spark.read.parquet(i) for i in s.inputs]).write.mode("overwrite").parquet(s.output)
    return decided
