"""Cutting texts at spaces that are pre-token boundaries, so that encoders can remember pieces.

The byte-level pattern lets a single space join the letters, digits or signs behind it, and a run of
white space gives up only its last character.  So a cut before a space is a boundary of the pattern,
unless that space is followed by white space or the end of the text: no cut is made there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

#: Characters of the longest piece that is remembered.
SHORT = 64

# The characters with the White_Space property, and four controls that some engines count too.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_UNSAFE = tuple(" " + c for c in _SPACES)
_UNSAFE_ASCII = tuple(x for x in _UNSAFE if x.isascii())
_CUT = re.compile(f" (?=[^{_SPACES}])")


def at_spaces(text: str) -> bool:
    """Whether every single space of a text is a boundary."""
    return not text.endswith(" ") and not any(x in text for x in (_UNSAFE_ASCII if text.isascii() else _UNSAFE))


def cut(text: str) -> list[str]:
    """Pieces p0, p1, ... with text = p0 + " " + p1 + ...; encoding p0, " " + p1, ... one by one equals encoding the whole."""
    return text.split(" ") if at_spaces(text) else _CUT.split(text)


class Memory:
    """Ids of pieces met before, in two generations: the older one goes when the younger is full.

    Pieces in use move to the younger generation, so they are never forgotten all at once, and the number
    held stays near twice ``most``.  Pieces over ``SHORT`` characters are not kept.
    """

    def __init__(self, most: int):
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def join(self, lists: list[list[str]], make: Callable[[list[str]], dict[str, bytes]]) -> list[bytes]:
        """The joined ids of each list of pieces; ``make`` gives those of pieces that aren't held."""
        wanted = set(chain.from_iterable(lists))
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        missing = wanted.difference(self.young)
        new = missing.difference(self.old)
        self.young.update((p, self.old[p]) for p in missing.difference(new))
        self.young.update(make(list(new)))
        ids = self.young.__getitem__
        out = [b"".join(map(ids, pieces)) for pieces in lists]
        for p in new:
            if len(p) > SHORT:
                del self.young[p]
        return out


class Pieces:
    """Ids of pieces met before, as one array with the place of each piece.

    Pieces come as Arrow strings: equal ones are found by Arrow, so only the different ones of a call are looked up.
    When ``most`` pieces (or ``SHORT`` / 4 characters a piece) are held, the next call starts anew.
    """

    def __init__(self, most: int, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.most, self.encode = most, encode
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.tokens, self.sizes, self.starts = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.held = self.used = self.chars = 0

    def learn(self, new: list[str]) -> None:
        ids, sizes = self.encode(new)
        if self.used + len(ids) > len(self.tokens):
            self.tokens = np.concatenate((self.tokens[: self.used], np.zeros(len(ids) + self.used // 2, np.uint32)))
        if self.held + len(new) > len(self.sizes):
            more = len(new) + self.held // 2
            self.sizes, self.starts = np.concatenate((self.sizes[: self.held], np.zeros(more, np.int32))), np.concatenate((self.starts[: self.held], np.zeros(more, np.int64)))
        self.tokens[self.used : self.used + len(ids)] = ids
        self.sizes[self.held : self.held + len(new)] = sizes
        self.starts[self.held : self.held + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.index.update(zip(new, range(self.held, self.held + len(new)), strict=True))
        self.held, self.used, self.chars = self.held + len(new), self.used + len(ids), self.chars + sum(map(len, new))

    def __call__(self, flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and each piece's number of ids."""
        if self.held > self.most or self.chars > self.most * SHORT // 4:
            self.forget()
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        known = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(known < 0)
        if len(missing):
            known[missing] = self.held + np.arange(len(missing))
            self.learn(words[missing].tolist())
        at = known[coded.indices.to_numpy()]
        sizes = self.sizes[at].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.tokens[np.arange(ends[-1]) + np.repeat(self.starts[at] - ends + sizes, sizes)], sizes


def portions(batches: Iterator[pa.RecordBatch], chars: int = 2_000_000) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of runs of rows with about ``chars`` characters; columns are doc_id and text, null text is empty."""
    for batch in batches:
        ids, texts, n = [], [], 0
        for i in range(batch.num_rows):
            t = batch.column(1)[i].as_py() or ""
            ids.append(batch.column(0)[i].as_py())
            texts.append(t)
            n += len(t)
            if n >= chars:
                yield ids, texts
                ids, texts, n = [], [], 0
        if ids:
            yield ids, texts
