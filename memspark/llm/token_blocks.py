"""Token ids as files of patched frame-of-reference blocks.

A segment holds the ids of some whole documents.  Its ids are cut into blocks of ``BLOCK``; a block stores
its minimum, the other values less the minimum at a bit width that covers ``PERCENTILE`` of them, and an
exception list (place, value) for those that do not fit.  An index gives the byte at which each block
starts, so any block can be read alone.

Segments are rows of a Parquet table (part, seq, first_token, n_tokens, payload), written by Spark's own
commit protocol to any store, in ascending doc_id order: parts are ranges of doc_id.  A lost executor
repeats its tasks and can't leave half a file.

Defined results: null text is empty and gives just the end id; null doc_id sorts first; rows that repeat a
doc_id are ordered by text; an empty table writes no segment.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import held
from .common import partitions_for, scratch_dir
from .pretoken import _CUT, Pieces, at_spaces, portions

BLOCK = 256
PERCENTILE = 95
END_ID = 2
SEGMENT_TOKENS = 1 << 20
#: Pieces that an encoder remembers before it starts anew.
PIECES = 2_000_000
#: Characters of the texts that are encoded together.
CHARS = 6_000_000
_HEAD = struct.Struct("<4sHHIII")
_INFO = np.dtype([("min", "<u4"), ("width", "u1"), ("exceptions", "<u2")])


def pack(values: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """index, block heads and payload for an array of unsigned 32-bit values."""
    n = len(values)
    count = -(-n // block)
    if not count:
        return b""
    v = np.empty(count * block, np.uint32)
    v[:n] = values
    v[n:] = values[-1]
    v = v.reshape(count, block)
    low = v.min(1)
    d = v - low[:, None]
    cover = np.partition(d, min(block - 1, int(block * percentile / 100)), axis=1)[:, min(block - 1, int(block * percentile / 100))]
    width = np.ceil(np.log2(cover.astype(np.float64) + 1)).astype(np.uint8)
    out = d.astype(np.uint64) >> width[:, None].astype(np.uint64) != 0
    info = np.zeros(count, _INFO)
    info["min"], info["width"], info["exceptions"] = low, width, out.sum(1)
    body: list[bytes] = [b""] * count
    packed = np.where(out, 0, d)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        kind = np.dtype(">u2") if w <= 16 else np.dtype(">u4")
        bits = np.unpackbits(packed[at].astype(kind).view(np.uint8).reshape(-1, kind.itemsize), axis=1)[:, 8 * kind.itemsize - int(w) :]
        for i, row in zip(at, np.packbits(bits.reshape(len(at), -1), axis=1), strict=True):
            body[i] = row.tobytes()
    for i in np.flatnonzero(info["exceptions"]):
        place = np.flatnonzero(out[i])
        body[i] += place.astype("<u2").tobytes() + d[i, place].astype("<u4").tobytes()
    starts = np.concatenate(([0], np.cumsum([len(x) for x in body]))).astype("<u4")
    return b"".join([starts.tobytes(), info.tobytes(), *body])


def unpack(data: bytes, n: int, block: int = BLOCK, only: slice | None = None) -> np.ndarray:
    """The values of ``pack``; ``only`` reads some of the blocks."""
    count = -(-n // block)
    if not count:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(data, "<u4", count + 1)
    info = np.frombuffer(data, _INFO, count, starts.nbytes)
    base = starts.nbytes + info.nbytes
    raw = np.frombuffer(data, np.uint8)
    at = np.arange(count)[only or slice(None)]
    out = np.zeros((len(at), block), np.uint32)
    for w in np.unique(info["width"][at]):
        own = np.flatnonzero(info["width"][at] == w)
        size = (block * int(w) + 7) // 8
        where = base + starts[at[own]].astype(np.int64)
        bits = np.unpackbits(raw[where[:, None] + np.arange(size)], axis=1)[:, : block * int(w)]
        kind = np.dtype(">u2") if w <= 16 else np.dtype(">u4")
        full = np.zeros((len(own) * block, 8 * kind.itemsize), np.uint8)
        full[:, 8 * kind.itemsize - int(w) :] = bits.reshape(-1, int(w)) if w else 0
        out[own] = np.packbits(full, axis=1).view(kind).reshape(len(own), block)
    for k in np.flatnonzero(info["exceptions"][at]):
        i = at[k]
        m = int(info["exceptions"][i])
        here = int(base + starts[i + 1]) - 6 * m
        out[k, np.frombuffer(data, "<u2", m, here)] = np.frombuffer(data, "<u4", m, here + 2 * m)
    out += info["min"][at][:, None]
    flat = out.reshape(-1)
    return flat[:n] if only is None else flat


def write_segment(ids: list[int | None], lengths: list[int], tokens: np.ndarray) -> bytes:
    # null ids sort first, so their number tells which they are
    head = _HEAD.pack(b"PFR1", BLOCK, 0, len(ids), len(tokens), ids.count(None))
    keys = np.array([i or 0 for i in ids], "<i8")
    return b"".join([head, keys.tobytes(), np.array(lengths, "<u4").tobytes(), pack(tokens)])


def read_segment(data: bytes) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """(doc ids, how many of them, at the start, are null, lengths, tokens) of a segment."""
    magic, block, _, docs, n, nulls = _HEAD.unpack_from(data)
    if magic != b"PFR1":
        raise ValueError("not a token segment")
    at = _HEAD.size
    keys = np.frombuffer(data, "<i8", docs, at)
    lengths = np.frombuffer(data, "<u4", docs, at + 8 * docs)
    return keys, nulls, lengths, unpack(memoryview(data)[at + 12 * docs :], n, block)


class LibraryEncoder:
    """Ids of texts by the tokenizers library; pieces met before are remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # a byte-level token has a character for each of its bytes
        vocabulary = self.library.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        #: The library takes these out of a text before it looks for pre-tokens, so texts with one are not cut.
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: Ids of " " + piece.
        self.known = Pieces(PIECES, self._encode)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        special = [any(s in t for s in self.special) for t in texts]
        plain = [not x and at_spaces(t) for t, x in zip(texts, special, strict=True)]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for simple in (True, False):
            own = [i for i, p in enumerate(plain) if p == simple]
            if not own:
                continue
            if simple:
                lists = pc.split_pattern(pa.array([texts[i] for i in own], pa.large_string()), " ")
            else:
                lists = pa.array([[texts[i]] if special[i] else _CUT.split(texts[i]) for i in own], pa.large_list(pa.large_string()))
            ends = lists.offsets.to_numpy()
            flat = lists.values
            # the first piece of a text has no space before it
            first = np.zeros(len(flat), bool)
            first[ends[:-1]] = True
            heads = self.library.encode_batch_fast(flat.filter(pa.array(first)).to_pylist(), add_special_tokens=False)
            tokens, sizes = self.known(flat.filter(pa.array(~first)))
            stops = np.concatenate(([0], np.cumsum(sizes)))[ends - np.arange(len(ends))]
            for i, h, j, k in zip(own, heads, stops[:-1].tolist(), stops[1:].tolist(), strict=True):
                out[i] = np.concatenate((np.array(h.ids, np.uint32), tokens[j:k]))
        return out

    def _encode(self, new: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces, one after the other, and their numbers: each piece begins at a boundary, so the ids are those of one long text."""
        ids, sizes = [], []
        for i in range(0, len(new), at_once):
            some = new[i : i + at_once]
            found = np.array(self.library.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            # tokens are counted off by their bytes
            ends = np.cumsum([len(x.encode()) + 1 for x in some])
            sizes.append(np.diff(np.searchsorted(np.cumsum(self.bytes[found]), ends, side="right"), prepend=0))
            ids.append(found)
        return np.concatenate(ids), np.concatenate(sizes)


def library_encoder(path: str) -> LibraryEncoder:
    """One encoder a Python worker: what it remembers lasts from task to task."""
    return held.only(("tokenizers", path), lambda: LibraryEncoder(path))


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = library_encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        ids: list = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        seq = first = n = 0

        def segment():
            tokens = np.concatenate(parts)
            cells = [part], [seq], [first], [len(tokens)], [write_segment(ids, lengths, tokens)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "first_token", "n_tokens", "payload"])

        for keys, texts in portions(batches, CHARS):
            for k, b in zip(keys, encode(texts), strict=True):
                ids.append(k)
                lengths.append(len(b) + 1)
                parts += (b, end)
                n += lengths[-1]
                if n >= SEGMENT_TOKENS:
                    yield segment()
                    seq, first, n, ids, lengths, parts = seq + 1, first + n, 0, [], [], []
        if ids:
            yield segment()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write their segments below ``path`` in ascending doc_id order."""
    n = partitions_for(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_encode(tokenizer, end_id), "part int, seq int, first_token long, n_tokens long, payload binary").write.option("compression", "none").parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, first, payload in zip(*(b.column(c).to_pylist() for c in ("part", "first_token", "payload")), strict=True):
            keys, nulls, lengths, tokens = read_segment(payload)
            ends = np.cumsum(lengths.astype(np.int64))
            raw = memoryview(tokens.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), part, np.int32)), pa.array(keys, mask=np.arange(len(keys)) < nulls), pa.array(first + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                ["part", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    segments = spark.read.schema("part int, seq int, first_token long, n_tokens long, payload binary").parquet(path)
    rows = segments.select("part", "first_token", "payload").mapInArrow(_decode, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # a row a file: its ids are added up in file order
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    path = f"{scratch_dir(docs.sparkSession)}/tokens"
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
