"""Byte-level BPE of whole texts through caches of space-led words.

A text is cut before every space that a non-space character follows. The tokenizer's own pre-tokenizer always starts
a new pre-token there (one space joins the word behind it, and a run of white space ends before that space), so the
ids of the cuts, one after the other, are the ids of the text, and each different cut is encoded once. Misses go to
the merge engine of tiktoken, filled with the vocabulary of the same file, where all characters belong to a range
whose Unicode classes have long been settled; all others (and anything with the special string) go to `tokenizers`.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

_SETTLED = re.compile(r"[\t\n\r -~¡-¬®-ɏ]*\Z")
_CUT = re.compile(r" (?=\S)")
#: The byte-level pre-tokenizer's pattern (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer cuts are encoded but not kept.
LONGEST_KEPT = 64


class _Irregular(Exception):
    """The text has a space that white space or the end follows."""


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """Ids of a cut, by the library or by an engine that gives the same."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        byte = _byte_of_char()
        ranks = {bytes(byte[c] for c in token): i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, cut: str) -> list[int]:
        if _SETTLED.match(cut) and not any(s in cut for s in self.special):
            return self.engine.encode_ordinary(cut)
        return self.library.encode(cut, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One for each worker process and file."""
    return Coder(path)


class _Memo(dict):
    def __init__(self, encode, known: dict, most: int):
        super().__init__()
        self.encode, self.known, self.most = encode, known, most

    def __missing__(self, cut: str):
        if not cut or cut[0].isspace():
            raise _Irregular
        if (found := self.known.get(cut)) is not None:
            self[cut] = found
            return found
        found = self.encode(" " + cut)
        if len(cut) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.clear()
            self[cut] = found
        return found


class Cached:
    """Encodes texts; `size` of a cut is kept when only lengths are asked for, its ids as bytes otherwise.

    known: the broadcast first tier, cuts (without their space) to lengths. most: entries of the worker's own tier,
    which starts again when full, so that memory stays bounded.
    """

    def __init__(self, path: str, known: dict | None = None, most: int = 400_000):
        self.coder = coder(path)
        self.lengths = _Memo(lambda c: len(self.coder.ids(c)), known or {}, most)
        self.bytes = _Memo(lambda c: np.asarray(self.coder.ids(c), "<u4").tobytes(), {}, most)

    def _cuts(self, text: str, memo: _Memo, add):
        head, *rest = text.split(" ")
        try:
            return head, add(map(memo.__getitem__, rest))
        except _Irregular:
            head, *rest = _CUT.split(text)
            return head, add(map(memo.__getitem__, rest))

    def count(self, text: str) -> int:
        head, n = self._cuts(text, self.lengths, sum)
        return n + (len(self.coder.ids(head)) if head else 0)

    def encoded(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        head, tail = self._cuts(text, self.bytes, b"".join)
        return np.asarray(self.coder.ids(head), "<u4").tobytes() + tail if head else tail
