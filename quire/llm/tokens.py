"""Token counts with public vocabularies; the vocabulary file is always a parameter."""

from __future__ import annotations

import base64
import re

import regex

#: Vocabulary used by the registered queries; any other file of the folder works as well.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the split pattern that belongs to the byte-level rank files.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same cuts by the faster engine, right for texts of only these characters: Latin
#: letters and common punctuation, where ``\\w`` without digits and ``_`` is ``\\p{L}``.
LATIN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
OTHER = re.compile("[^\\t\\n\\r\\x20-\\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e]")

#: A single pre-token above this many tokens is cut further, at character bounds.
ATOM_TOKENS = 16

#: Words remembered by one worker; beyond it the memory is emptied, the counts stay the same.
MEMORY = 400_000

_LOADED: dict = {}


class Counter:
    """Counts tokens and cuts text into atoms whose counts add up.

    Rank files (``.tiktoken``) are cut by their own pre-token pattern, so the sum over
    atoms equals the count of the whole text. For the other kinds atoms are words with
    the white space before them; their sum bounds the size well but callers that need a
    guarantee count the finished piece again with :meth:`count`.
    """

    def __init__(self, path: str):
        self.path, self.memory = path, {}
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = tiktoken.Encoding("own", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})
            self.encode, self.exact = own.encode_ordinary, True
            general = regex.compile(PRETOKEN).findall
            self.find = lambda t: general(t) if OTHER.search(t) else LATIN.findall(t)
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            self.encode, self.exact = lambda t: own.encode(t, add_special_tokens=False).ids, False
            self.find = regex.compile(r"\s*\S+|\s+").findall
        else:
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode, self.exact = lambda t: own.encode(t, num_threads=1), False
            self.find = regex.compile(r"\s*\S+|\s+").findall

    def _of(self, words: list[str]) -> list[int]:
        memory = self.memory
        try:
            return [memory[w] for w in words]
        except KeyError:
            if len(memory) > MEMORY:
                memory.clear()
            for w in words:
                if w not in memory:
                    memory[w] = len(self.encode(w))
            return [memory[w] for w in words]

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return sum(self._of(self.find(text))) if self.exact else len(self.encode(text))

    def atoms(self, text: str) -> tuple[list[str], list[int]]:
        """Consecutive slices that make up the text, and the tokens of each."""
        words = self.find(text)
        sizes = self._of(words)
        if max(sizes, default=0) <= ATOM_TOKENS:
            return words, sizes
        slices, counts = [], []
        for word, n in zip(words, sizes):
            if n <= ATOM_TOKENS:
                slices.append(word)
                counts.append(n)
                continue
            step = max(1, len(word) * ATOM_TOKENS // (2 * n))
            for i in range(0, len(word), step):
                slices.append(word[i : i + step])
                counts.append(len(self.encode(word[i : i + step])))
        return slices, counts


def counter(path: str) -> Counter:
    """The counter of a vocabulary file, loaded once in each worker process."""
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]
