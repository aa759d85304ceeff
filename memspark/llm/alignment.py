"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often.

Tokenizer A (byte-level BPE) encodes space + text, tokenizer B (sentence pieces) the text, to which it adds the
space.  Byte offsets where tokens of both end cut a text into groups; within a group every token of A is linked
with every token of B.  A pair's count is the number of documents that hold it linked.

1. Texts are encoded piece by piece (a piece ends before a single space that neither vocabulary spans); each
   piece's groups and pairs are worked out once and remembered.  A task cuts its documents into blocks of about
   ``BLOCK_RECORDS`` (pair, document, times) records, sorts a block side-major (A id, then B id, then document)
   and spills it as zstd runs, one per radix of the A id.  A run has a head (pair, number of documents) and a
   body (documents, times).
2. Per radix, the heads of all blocks meet in a k-way heap merge.  Pairs come in order of their A id, so as soon
   as an A id ends its highest count is known, and counts and "is the highest" stream back to each run, in the
   run's own order.  A pair that every document holds costs one entry a block, not one a document.  More than
   ``FAN`` blocks are merged in a tree, and their counts come down the same tree.
3. Each block reads its bodies with the counts and adds them up for its documents.

Only heads and counts cross the network between blocks; memory is bounded by one block, or by ``FAN`` heads of
one radix.  Runs are Parquet rows in the shared folder, so a lost executor repeats only its tasks.

Defined results: null, empty, and texts that A's or B's tokens don't give back byte by byte (such as texts with
U+2581) have no tokens, zeros and '' for ``groups_sha256``; special tokens inside texts are plain text; each row
is a document of its own, so repeated rows and null ids count as often as they occur; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import held
from .common import materialize
from .pretoken import _SPACES, _UNSAFE, SHORT, portions

#: Records of a block before it is spilled, and documents at most.
BLOCK_RECORDS = 1_500_000
BLOCK_DOCS = 50_000
#: Radix classes of A ids: a power of two up to 1,024.
RADIX = 64
#: Runs that one heap merges.
FAN = 256
#: Pieces that an aligner remembers before it starts anew, and characters of a text taken at a time.
PIECES = 400_000
SECTION = 1_000_000
_CUT = re.compile(f"(?<! ) (?=[^{_SPACES}])")
_RUN = "block long, radix int, heads binary, body binary, idx int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_RUN_SCHEMA = pa.schema([("block", pa.int64()), ("radix", pa.int32()), ("heads", pa.binary()), ("body", pa.binary()), ("idx", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])


def pieces(text: str) -> list[str]:
    """p0, p1, ... with text = p0 + " " + p1 + ...; no token of A or B spans the space before a piece and what is before it."""
    if text[:1] == " " or text[-1:] == " " or any(x in text for x in _UNSAFE):
        return _CUT.split(text)
    return text.split(" ")


def sections(text: str, most: int = SECTION) -> Iterator[list[str]]:
    """The pieces of a text, a bounded number of characters at a time."""
    at = 0
    while len(text) - at > most:
        found = _CUT.search(text, at + most)
        if not found:
            break
        # the cut's own look at both sides holds for the parts, too
        yield pieces(text[at : found.start()])
        at = found.end()
    yield pieces(text[at:] if at else text)


def groups_of(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[list[int], list[int]]]:
    """Groups of (id, number of bytes) tokens of two sides that cover the same bytes."""
    out, i, j, at, bt = [], 0, 0, 0, 0
    left: list[int] = []
    right: list[int] = []
    while i < len(a) or j < len(b):
        if at <= bt and i < len(a):
            left.append(a[i][0])
            at += a[i][1]
            i += 1
        else:
            right.append(b[j][0])
            bt += b[j][1]
            j += 1
        if at == bt:
            out.append((left, right))
            left, right = [], []
    return out


class Aligner:
    """Both tokenizers, and the groups and pairs of the pieces met before."""

    def __init__(self, path_a: str, path_b: str, radix: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.shift = radix.bit_length() - 1
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in set(own)]
        byte = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(rest)}
        words = self.a.get_vocab()
        self.bytes_a = [b""] * (max(words.values()) + 1)
        for w, i in words.items():
            self.bytes_a[i] = bytes(byte[c] for c in w) if all(c in byte for c in w) else w.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            p = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
        self.size_a, self.size_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        self.said = [f"{i}{x}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for x in (",", "|", ";", "\n")]
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.text: list[str] = []
        # n_a, n_b, groups, links, in order, first pair, number of pairs
        self.facts = np.zeros((1024, 7), np.int64)
        self.pairs = np.zeros(4096, np.uint32)
        self.times = np.zeros(4096, np.int64)
        self.used = 0

    def place(self, a):
        """A ids by their radix first, so that a sorted block is a sequence of radix classes."""
        return (a & ((1 << self.shift) - 1)) << (16 - self.shift) | a >> self.shift

    def learn(self, new: list[str], at_once: int = 20_000) -> None:
        plain = [p for p in new if p and len(p) <= SHORT and " " not in p and "\u2581" not in p]
        for k in range(0, len(plain), at_once):
            if not self._learn_together(plain[k : k + at_once]):
                self._learn_alone(plain[k : k + at_once])
        if len(plain) < len(new):
            known = set(plain)
            self._learn_alone([p for p in new if p not in known])

    def _learn_alone(self, some: list[str]) -> None:
        for k in range(0, len(some), 1000):
            part = some[k : k + 1000]
            left = self.a.encode_batch_fast([" " + p for p in part], add_special_tokens=False)
            right = self.b.encode(part, num_threads=1)
            for piece, x, ids_b in zip(part, left, right, strict=True):
                self._add(piece, x.ids, ids_b or ([] if piece else self._alone()))

    def _learn_together(self, some: list[str]) -> bool:
        """Short pieces without spaces, as one text that is cut at their ends; False if its bytes don't come back."""
        text = " ".join(some)
        raw = (" " + text).encode()
        ids_a, ids_b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != raw or b"".join(map(self.bytes_b.__getitem__, ids_b)) != raw:
            return False
        a, b = np.array(ids_a), np.array(ids_b)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.cumsum([len(p.encode()) + 1 for p in some])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        if not np.isin(ends, cuts).all():
            return False
        piece = np.searchsorted(ends, cuts)
        many_a, many_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        # every token of A with every token of B of its group
        times = many_b[group_a]
        stop = np.cumsum(times)
        other = np.arange(stop[-1]) - np.repeat(stop - times, times) + np.repeat((np.cumsum(many_b) - many_b)[group_a], times)
        link = np.repeat(piece[group_a] << 32 | self.place(a) << 15, times) | b[other]
        link, count = _summed(link, np.ones(len(link), np.int64))
        owner, first = link >> 32, len(self.text)
        each = np.bincount(owner, minlength=len(some))
        while first + len(some) > len(self.facts):
            self.facts = np.concatenate((self.facts, np.zeros_like(self.facts)))
        self._room(len(link))
        self.pairs[self.used : self.used + len(link)], self.times[self.used : self.used + len(link)] = link & 0xFFFFFFFF, count
        sums = [np.bincount(piece, many_a), np.bincount(piece, many_b), np.bincount(piece), np.bincount(piece, many_a * many_b), np.ones(len(some)), self.used + np.cumsum(each) - each, each]
        self.facts[first : first + len(some)] = np.stack(sums, 1).astype(np.int64)
        self.used += len(link)
        # ids with what follows them: the side's next id, the other side, the next group, the next piece
        after_a = np.where(np.append(group_a[1:] != group_a[:-1], True), 1, 0)
        last_b = np.append(group_b[1:] != group_b[:-1], True)
        after_b = np.where(last_b, np.where(np.isin(end_b, ends), 3, 2), 0)
        order = np.lexsort((np.repeat([0, 1], [len(a), len(b)]), np.concatenate((group_a, group_b))))
        codes = np.concatenate((a * 4 + after_a, b * 4 + after_b))[order]
        self.text += "".join(map(self.said.__getitem__, codes.tolist())).split("\n")[:-1]
        self.index.update(zip(some, range(first, first + len(some)), strict=True))
        return True

    def _room(self, more: int) -> None:
        while self.used + more > len(self.pairs):
            self.pairs, self.times = np.concatenate((self.pairs, np.zeros_like(self.pairs))), np.concatenate((self.times, np.zeros_like(self.times)))

    def _alone(self) -> list[int]:
        """An empty piece still has its space, which B adds to no empty text."""
        return [self.b.piece_to_id("▁")]

    def _add(self, piece: str, ids_a: list[int], ids_b: list[int]) -> None:
        raw = (" " + piece).encode()
        a, b = [self.bytes_a[i] for i in ids_a], [self.bytes_b[i] for i in ids_b]
        good = b"".join(a) == raw == b"".join(b)
        groups = groups_of([(i, len(x)) for i, x in zip(ids_a, a, strict=True)], [(i, len(x)) for i, x in zip(ids_b, b, strict=True)]) if good else []
        links: Counter = Counter()
        for x, y in groups:
            if len(x) == 1 and len(y) == 1:
                links[self.place(x[0]) << 15 | y[0]] += 1
            else:
                cx, cy = Counter(x), Counter(y)
                for i, m in cx.items():
                    for j, n in cy.items():
                        links[self.place(i) << 15 | j] += m * n
        n = len(self.text)
        if n == len(self.facts):
            self.facts = np.concatenate((self.facts, np.zeros_like(self.facts)))
        self._room(len(links))
        end = self.used + len(links)
        self.pairs[self.used : end], self.times[self.used : end] = list(links.keys()), list(links.values())
        self.facts[n] = len(ids_a), len(ids_b), len(groups), sum(len(x) * len(y) for x, y in groups), good, self.used, len(links)
        self.used = end
        self.text.append(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups))
        self.index[piece] = n

    def __call__(self, flat: list[str]) -> np.ndarray:
        """Numbers of the pieces."""
        wanted = set(flat)
        if len(self.index) > PIECES:
            self.forget()
        new = [p for p in wanted if p not in self.index]
        if new:
            self.learn(new)
        return np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))


def aligner(path_a: str, path_b: str, radix: int) -> Aligner:
    return held.only(("align", path_a, path_b, radix), lambda: Aligner(path_a, path_b, radix))


def _zip(*arrays: np.ndarray) -> bytes:
    import zstandard

    raw = b"".join([np.array([len(x) for x in arrays], "<u4").tobytes(), *(x.astype("<u4").tobytes() for x in arrays)])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unzip(data: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64)
    flat = np.frombuffer(raw, "<u4", offset=4 * n)
    return [flat[e - k : e] for e, k in zip(ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True)]


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys as one, sorted."""
    if not len(key):
        return key, times
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(times, first)


class _Block:
    """Documents and records of a block under way; a record's key is pair << 24 | document."""

    def __init__(self):
        self.docs: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.bad: list[int] = []
        self.records = 0

    def runs(self, number: int, shift: int) -> Iterator[pa.RecordBatch]:
        key, times = _summed(np.concatenate([*self.keys, np.zeros(0, np.int64)]), np.concatenate([*self.times, np.zeros(0, np.int64)]))
        if self.bad:
            keep = ~np.isin(key & 0xFFFFFF, self.bad)
            key, times = key[keep], times[keep]
        radix, heads, bodies = [], [], []
        cuts = np.searchsorted(key, np.arange((1 << shift) + 1) << (16 - shift + 15 + 24))
        for r in range(1 << shift):
            k, t = key[cuts[r] : cuts[r + 1]], times[cuts[r] : cuts[r + 1]]
            if len(k):
                pair, n = np.unique(k >> 24, return_counts=True)
                radix.append(r)
                heads.append(_zip(np.diff(pair, prepend=0), n))
                bodies.append(_zip(k & 0xFFFFFF, t))
        yield _rows(block=[number] * len(radix), radix=radix, heads=heads, body=bodies)
        d = list(zip(*self.docs, strict=True)) or [[]] * 6
        yield _rows(block=[number] * len(self.docs), radix=[-1] * len(self.docs), idx=list(range(len(self.docs))), doc_id=d[0], n_a=d[1], n_b=d[2], n_groups=d[3], n_links=d[4], groups_sha256=d[5])


def _rows(**columns: list) -> pa.RecordBatch:
    n = len(columns["block"])
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name) or [None] * n, f.type) for f in _RUN_SCHEMA], schema=_RUN_SCHEMA)


def _spill(path_a: str, path_b: str, radix: int, most: int):
    shift = radix.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b, radix)
        part, number, block = TaskContext.get().partitionId(), 0, _Block()
        # a document's parts wait until there are enough pieces for one step
        waiting: list[tuple[int, list[str]]] = []
        sums: dict[int, list] = {}

        def step() -> None:
            flat = list(chain.from_iterable(p for _, p in waiting))
            if not flat:
                return
            at = align(flat)
            size = np.array([len(p) for _, p in waiting])
            starts = np.concatenate(([0], np.cumsum(size)[:-1]))
            facts = align.facts[at]
            total = np.add.reduceat(facts[:, :4], starts).tolist()
            good = np.minimum.reduceat(facts[:, 4], starts)
            number_of = at.tolist()
            for (d, _), i, n, t, g in zip(waiting, starts.tolist(), size.tolist(), total, good.tolist(), strict=True):
                s = sums[d]
                s[1] = [x + y for x, y in zip(s[1], t, strict=True)]
                s[3] = s[3] and bool(g)
                said = ";".join(map(align.text.__getitem__, number_of[i : i + n]))
                s[2].update((b";" if s[4] else b"") + said.encode())
                s[4] = True
            doc = np.repeat(np.array([d for d, _ in waiting]), size)
            k, n = np.unique(doc << 32 | at, return_counts=True)
            piece, doc = k & 0xFFFFFFFF, k >> 32
            first, many = align.facts[piece, 5], align.facts[piece, 6]
            ends = np.cumsum(many)
            where = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(first, many)
            key, times = _summed(align.pairs[where].astype(np.int64) << 24 | np.repeat(doc, many), align.times[where] * np.repeat(n, many))
            block.keys.append(key)
            block.times.append(times)
            block.records += len(key)
            waiting.clear()

        def settle() -> None:
            step()
            for d in sorted(sums):
                i, t, h, ok, _ = sums.pop(d)
                block.docs[d] = (i, *t, h.hexdigest()) if ok else (i, 0, 0, 0, 0, "")
                if not ok:
                    block.bad.append(d)

        size = 0
        for ids, texts in portions(batches):
            for i, text in zip(ids, texts, strict=True):
                d = len(block.docs)
                block.docs.append((i, 0, 0, 0, 0, ""))
                if text:
                    sums[d] = [i, [0, 0, 0, 0], hashlib.sha256(), True, False]
                    for p in sections(text):
                        waiting.append((d, p))
                        size += len(p)
                        if size > 200_000:
                            step()
                            size = 0
                if block.records >= most or len(block.docs) >= BLOCK_DOCS:
                    settle()
                    yield from block.runs(part << 32 | number, shift)
                    number, block = number + 1, _Block()
        settle()
        if block.docs:
            yield from block.runs(part << 32 | number, shift)

    return run


def _stream(data: bytes, run: int) -> Iterator[tuple[int, int, int]]:
    gaps, n = _unzip(data, 2)
    return zip(np.cumsum(gaps, dtype=np.int64).tolist(), n.tolist(), [run] * len(n))


def _merged(heads: list[bytes]) -> Iterator[list[tuple[int, int, list[int]]]]:
    """For each A id in order its pairs: (pair, documents, runs that hold it)."""
    now, out = -1, []
    for pair, n, run in heapq.merge(*(_stream(h, i) for i, h in enumerate(heads))):
        if pair >> 15 != now:
            if out:
                yield out
            now, out = pair >> 15, []
        if out and out[-1][0] == pair:
            out[-1][1] += n
            out[-1][2].append(run)
        else:
            out.append([pair, n, [run]])
    if out:
        yield out


def _raise_runs(table: pa.Table) -> pa.Table:
    """One run of summed heads for a group of runs."""
    pairs, counts = [], []
    for side in _merged(table["heads"].to_pylist()):
        for pair, n, _ in side:
            pairs.append(pair)
            counts.append(n)
    blob = _zip(np.diff(np.array(pairs, np.int64), prepend=0), np.array(counts, np.int64))
    return pa.table({"radix": pa.array([table["radix"][0].as_py()], pa.int32()), "id": pa.array([table["up"][0].as_py()], pa.int64()), "heads": pa.array([blob], pa.binary())})


def _settle(table: pa.Table) -> pa.Table:
    """Counts, and whether they are their A id's highest, for each run in its own order."""
    heads = table["heads"].to_pylist()
    counts: list[list[int]] = [[] for _ in heads]
    for side in _merged(heads):
        most = max(n for _, n, _ in side)
        for _, n, runs in side:
            said = 2 * n + (n == most)
            for r in runs:
                counts[r].append(said)
    return pa.table({"radix": table["radix"].cast(pa.int32()), "id": table["id"], "counts": pa.array([_zip_counts(c) for c in counts], pa.binary())})


def _zip_counts(c) -> bytes:
    c = np.array(c, np.int64)
    return _zip(c & 0xFFFFFFFF, c >> 32)


def _unzip_counts(data: bytes) -> np.ndarray:
    low, high = _unzip(data, 2)
    return low.astype(np.int64) | high.astype(np.int64) << 32


def _lower(children: pa.Table, parents: pa.Table) -> pa.Table:
    """Counts of a merged run go down to the runs it was made of."""
    gaps, _ = _unzip(parents["heads"][0].as_py(), 2)
    pairs, counts = np.cumsum(gaps, dtype=np.int64), _unzip_counts(parents["counts"][0].as_py())
    out = []
    for h in children["heads"].to_pylist():
        own = np.cumsum(_unzip(h, 2)[0], dtype=np.int64)
        out.append(_zip_counts(counts[np.searchsorted(pairs, own)]))
    return pa.table({"radix": children["radix"].cast(pa.int32()), "id": children["id"], "counts": pa.array(out, pa.binary())})


def run_counts(heads: DataFrame, fan: int = FAN) -> DataFrame:
    """(radix, id, counts) for runs (radix, id, heads): a tree of heap merges up, and the counts down again."""
    n = heads.select("id").distinct().count()
    if n <= fan:
        return heads.groupBy("radix").applyInArrow(_settle, "radix int, id long, counts binary")
    groups = -(-n // fan)
    own = heads.withColumn("up", F.pmod(F.xxhash64("id"), F.lit(groups)))
    above = materialize(own.groupBy("radix", "up").applyInArrow(_raise_runs, "radix int, id long, heads binary"), "merged")
    told = materialize(run_counts(above, fan), "told")
    parents = above.join(told, ["radix", "id"]).withColumnRenamed("id", "up")
    return own.groupBy("radix", "up").cogroup(parents.groupBy("radix", "up")).applyInArrow(_lower, "radix int, id long, counts binary")


def _finish(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """The sums of a block's documents."""
    radix = runs["radix"].to_numpy()
    docs = runs.take(pa.array(np.flatnonzero(radix < 0))).sort_by("idx")
    best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    said = dict(zip(counts["radix"].to_pylist(), counts["counts"].to_pylist(), strict=True))
    for i in np.flatnonzero(radix >= 0).tolist():
        n = _unzip(runs["heads"][i].as_py(), 2)[1]
        doc, times = _unzip(runs["body"][i].as_py(), 2)
        c = np.repeat(_unzip_counts(said[int(radix[i])]), n)
        t = times.astype(np.int64)
        np.add.at(total, doc, t * (c >> 1))
        np.add.at(best, doc, t * (c & 1))
    return pa.table({**{k: docs[k] for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, "n_best": best, "count_sum": total, "groups_sha256": docs["groups_sha256"]})


def spill_runs(docs: DataFrame, path_a: str, path_b: str, radix: int = RADIX, block_records: int = BLOCK_RECORDS) -> DataFrame:
    """Step 1: runs and documents of every block, written to the shared folder."""
    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_spill(path_a, path_b, radix, block_records), _RUN), "runs")


def _pairs_of(radix: int):
    shift = radix.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for heads, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pair, c = np.cumsum(_unzip(heads, 2)[0], dtype=np.int64), _unzip_counts(counts)
                place = pair >> 15
                a = (place & ((1 << (16 - shift)) - 1)) << shift | place >> (16 - shift)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(pair & 0x7FFF), pa.array(c >> 1), pa.array((c & 1).astype(bool))], ["a", "b", "n_docs", "best"])

    return run


def pair_counts(docs: DataFrame, path_a: str, path_b: str, radix: int = RADIX, block_records: int = BLOCK_RECORDS, fan: int = FAN) -> DataFrame:
    """(a, b, n_docs, best): each linked pair of ids, its documents, and whether no other B id has more with this A id."""
    heads = spill_runs(docs, path_a, path_b, radix, block_records).filter("radix >= 0").select("radix", F.col("block").alias("id"), "heads")
    return heads.join(run_counts(heads, fan), ["radix", "id"]).select("heads", "counts").mapInArrow(_pairs_of(radix), "a long, b long, n_docs long, best boolean").distinct()


def align(docs: DataFrame, path_a: str, path_b: str, radix: int = RADIX, block_records: int = BLOCK_RECORDS, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    runs = spill_runs(docs, path_a, path_b, radix, block_records)
    heads = runs.filter("radix >= 0").select("radix", F.col("block").alias("id"), "heads")
    counts = materialize(run_counts(heads, fan), "counts").withColumnRenamed("id", "block")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return runs.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_finish, schema)
