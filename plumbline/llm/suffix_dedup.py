"""Removal of byte strings that documents with smaller ids hold too, by interval expansion over sorted suffixes.

Equal strings of the least length are brought together without sorting the corpus: each such string (window) is
dealt by the least hash of its short substrings, and neighbouring windows with the same least hash travel as one
piece. Only pieces whose hash occurs in two documents travel at all; windows of a hash that very many batches have
travel apart, dealt by all of their bytes. Equal pieces travel once, with the least and the largest document.

Within a task, intervals of equal strings grow backwards from length 1, a byte at a time, all intervals of a length at
once, along the Burrows-Wheeler order: the transform (the byte before each suffix) is read in suffix order, and a
stable counting sort by it, which is the step from last to first column, gives the order of the longer strings.
Intervals of one document end early, and so do those of one window, which equal no other string; those that reach the
least length are the common prefixes sought, and no longer ones are derived. Every byte that goes is in a window of
such an interval.

Large tables are done in rounds, each for a part of the hashes: a round's pieces are on disk only until its masks are
written, so no more than a part of all pieces ever is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.llm.common import as_bytes, blocks, mixed, spread, trim, written
from plumbline.runtime import recorded, remove, scratch

#: Bytes of text in a batch, bytes of hashes that one task sorts, shared hashes whose pieces it sorts, windows of a
#: piece at most.
BATCH_BYTES, HASH_BYTES, PIECE_HASHES, PIECE = 12 << 20, 12 << 20, 1 << 16, 32
SEED_BYTES = 16
#: Batches that have a hash, from which on its windows travel one by one; buckets of the texts' table at most.
HOT_BATCHES, MOST_BUCKETS = 256, 50_000
#: Bytes of text from which on there is a further round, and rounds at most: each reads all texts again.
ROUND_BYTES, ROUNDS = 1 << 29, 4


def _codec(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _plain(packed: pa.Buffer) -> np.ndarray:
    size = int.from_bytes(packed[:8].to_pybytes(), "little")
    return np.frombuffer(pa.decompress(packed[8:], size, "zstd"), np.uint8)


def pieces(at: np.ndarray, data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one least hash: place of the first window, their number, 48 bits of the hash.

    Which hash a window has depends on its bytes alone, so equal windows meet wherever they are.
    """
    base, end = int(at[0]), int(at[-1])
    x = data[base:end].astype(np.uint64)
    n, q = len(x), min(SEED_BYTES, least)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    two = x[:-1] | x[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    if q >= 8:
        eight = four[:-4] | four[4:] << np.uint64(32)
        m = n - q + 1
        h = mixed(eight[:m] * np.uint64(0x9E3779B97F4A7C15) + eight[q - 8 : q - 8 + m])
    else:
        q = min(q, 4)
        h = mixed(four[: n - 3] if q == 4 else x)
    span, reach = 1, least - q + 1  # a window holds so many substrings
    while 2 * span <= reach:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if span < reach:
        h = np.minimum(h[: len(h) - (reach - span)], h[reach - span :])
    sizes = np.diff(at)
    valid = np.nonzero(np.repeat(at[1:] - base, sizes) - np.arange(n) >= least)[0]
    if not valid.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    v = h[valid]
    begin = np.concatenate([[0], np.nonzero((np.diff(valid) > 1) | (v[1:] != v[:-1]))[0] + 1])
    count = np.diff(np.append(begin, len(valid)))
    parts = -(-count // PIECE)
    step = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(valid[begin], parts) + step * PIECE
    return start, np.minimum(np.repeat(count, parts) - step * PIECE, PIECE), np.repeat(v[begin], parts) >> np.uint64(16)


def lowest_documents(text: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of `least` bytes that begin at `start` in `text`, held by documents from `low` to `high`: the least
    document that has the same string, and whether two have it.

    The frontier holds the suffixes of all intervals that still have two documents, in suffix order; `interval`
    numbers them. Depth grows by one byte a step from the right end of the windows to their left. An interval of one
    window is settled: no other window here has its string, whatever the bytes before.
    """
    lowest, several = low.copy(), np.zeros(len(start), bool)
    entry, interval = np.arange(len(start)), np.zeros(len(start), np.int64)
    for depth in range(1, least + 1):
        if not entry.size:
            break
        before = text[start[entry] + (least - depth)]
        by = np.argsort(before, kind="stable")  # equal bytes keep their suffixes' order, which sorts the longer strings
        entry, interval, before = entry[by], interval[by], before[by]
        new = np.ones(len(entry), bool)
        new[1:] = (interval[1:] != interval[:-1]) | (before[1:] != before[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(entry)))
        least_doc = np.minimum.reduceat(low[entry], first)
        two = np.maximum.reduceat(high[entry], first) > least_doc
        several[entry[first[two & (size == 1)]]] = True
        if depth == least:
            lowest[entry], several[entry] = np.repeat(least_doc, size), np.repeat(two, size)
        live = np.repeat(two & (size > 1), size)
        interval = np.repeat(np.arange(len(size)), size)[live]
        entry = entry[live]
    return lowest, several


def shared_windows(text: np.ndarray, start: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For windows of one document each: is the same string in a smaller document?"""
    return lowest_documents(text, start, doc, doc, least)[0] < doc


def _batches(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(batch, volume, ids, sizes, text): rows of about BATCH_BYTES of texts, packed; a longer text is a row of its own.
    carry: `rows` has all columns of the documents but their texts."""

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids, texts, held, others = [], [], 0, []

        def row() -> pa.RecordBatch:
            sizes = np.array(list(map(len, texts)), np.int64).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), pa.array([held], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([sizes], pa.binary()), pa.array([_codec(b"".join(texts))], pa.binary()), pa.array([_stored(others) if others else None], pa.binary())], ["batch", "volume", "ids", "sizes", "text", "rows"])

        for batch in source:
            plain, first = batch.drop_columns(["d", "t"]), 0
            for i, (d, t) in enumerate(zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), strict=True)):
                ids.append(d)
                texts.append(t)
                held += len(t)
                if held >= BATCH_BYTES:
                    if carry:
                        others.append(plain.slice(first, i + 1 - first))
                    yield row()
                    ids, texts, held, others, first, k = [], [], 0, [], i + 1, k + 1
            if carry and first < batch.num_rows:
                others.append(plain.slice(first))
        if ids:
            yield row()

    others = [F.col(c).alias(f"c_{c}") for c in docs.columns if c != "text"] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").cast("binary").alias("t"), *others).dropna(subset=["d", "t"])
    return rows.mapInArrow(run, "batch long, volume long, ids binary, sizes binary, text binary, rows binary")


def _stored(parts: list[pa.RecordBatch]) -> bytes:
    """Rows as one Arrow stream."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        for p in parts:
            w.write_batch(p)
    return out.getvalue().to_pybytes()


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"].as_buffer(), np.int64)
    at = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"].as_buffer(), np.int64))])
    return ids, at, _plain(row["text"].as_buffer())


def _all_pieces(at: np.ndarray, data: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    found = [(s + at[i], c, h) for i, j in blocks(at) for s, c, h in [pieces(at[i : j + 1], data, least)]]
    start, count, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return start, count, h, np.searchsorted(at, start, "right") - 1


def _six(h: np.ndarray) -> bytes:
    """48-bit numbers as two columns of 32 and 16 bits."""
    return (h & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (h >> np.uint64(32)).astype("<u2").tobytes()


def _from_six(raw) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) | np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def _hashes(batches: DataFrame, least: int, n_buckets: int) -> DataFrame:
    """(bucket, batch, once, more): the batch's different hashes, apart by whether two of its documents have them."""

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("batch", "ids", "sizes", "text")}
                _, at, data = _opened(row)
                _, _, h, doc = _all_pieces(at, data, least)
                by = np.lexsort((doc, h))
                h, doc = h[by], doc[by]
                first = np.concatenate([[0], np.nonzero(np.diff(h))[0] + 1]) if len(h) else np.zeros(0, int)
                last = np.append(first[1:], len(h)) - 1
                many = doc[first] != doc[last] if len(h) else np.zeros(0, bool)
                h = h[first]
                bucket = (h % np.uint64(n_buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                h, many, bucket = h[by], many[by], bucket[by]
                edge = np.searchsorted(bucket, np.arange(n_buckets + 1))
                some = np.nonzero(np.diff(edge))[0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int64()),
                        pa.array(np.full(len(some), row["batch"].as_py()), pa.int64()),
                        pa.array([_six(h[edge[b] : edge[b + 1]][~many[edge[b] : edge[b + 1]]]) for b in some.tolist()], pa.binary()),
                        pa.array([_six(h[edge[b] : edge[b + 1]][many[edge[b] : edge[b + 1]]]) for b in some.tolist()], pa.binary()),
                    ],
                    ["bucket", "batch", "once", "more"],
                )
                del data, h, doc
                trim()

    return batches.mapInArrow(run, "bucket long, batch long, once binary, more binary")


def _shared(hashes: DataFrame, hot: int) -> DataFrame:
    """(bucket, batch, hashes, hot): those that two documents have, apart by whether `hot` batches or more have them. A
    batch tells each hash once, however many copies it holds."""

    def run(key: tuple, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, owner, many, names = [], [], [], []
        for batch in source:
            for k in range(batch.num_rows):
                for column, flag in (("once", False), ("more", True)):
                    x = _from_six(batch.column(column)[k].as_buffer())
                    h.append(x)
                    owner.append(np.full(len(x), len(names), np.int32))
                    many.append(np.full(len(x), flag))
                names.append(batch.column("batch")[k].as_py())
        h, owner, many = np.concatenate(h), np.concatenate(owner), np.concatenate(many)
        by = np.argsort(h, kind="stable")
        h, owner, many = h[by], owner[by], many[by]
        same = h[1:] == h[:-1]
        keep = many.copy()
        keep[1:] |= same
        keep[:-1] |= same
        first = np.concatenate([[0], np.flatnonzero(~same) + 1]) if len(h) else np.zeros(0, int)
        size = np.diff(np.append(first, len(h)))
        often = np.repeat(size >= hot, size)
        h, owner, often = h[keep], owner[keep], often[keep]
        by = np.lexsort((often, owner))
        h, owner, often = h[by], owner[by], often[by]
        edge = np.searchsorted(owner, np.arange(len(names) + 1))
        middle = edge[1:] - np.bincount(owner[often], minlength=len(names))
        some = np.nonzero(np.diff(edge))[0].tolist()
        trim()
        columns = [[key[0].as_py()] * len(some), [names[i] for i in some], [_six(h[edge[i] : middle[i]]) for i in some], [_six(h[middle[i] : edge[i + 1]]) for i in some]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "batch", "hashes", "hot"])

    return hashes.groupBy("bucket").applyInArrow(run, "bucket long, batch long, hashes binary, hot binary")


def _one_by_one(data: np.ndarray, start: np.ndarray, count: np.ndarray, h: np.ndarray, doc: np.ndarray, hot: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """The pieces, with those marked as hot cut into single windows, whose hash is one of all of their bytes."""
    some = np.flatnonzero(hot)
    if not some.size:
        return start, count, h, doc
    begin, owner = spread(start[some], count[some]), np.repeat(doc[some], count[some])
    whole = np.zeros(len(begin), np.uint64)
    for k in range(least):
        whole = (whole + data[begin + k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        whole ^= whole >> np.uint64(32)
    start, count = np.concatenate([start[~hot], begin]), np.concatenate([count[~hot], np.ones(len(begin), np.int64)])
    h, doc = np.concatenate([h[~hot], mixed(whole) >> np.uint64(16)]), np.concatenate([doc[~hot], owner])
    by = np.argsort(start, kind="stable")
    return start[by], count[by], h[by], doc[by]


def _parted(batches: DataFrame, shared: DataFrame, least: int, n_buckets: int, first_bucket: int = 0) -> DataFrame:
    """(batch, bucket, body): for each batch and bucket (from first_bucket on) the different pieces with shared hashes
    and the least and the largest document of each; and for each batch, in a bucket below 0, where its pieces are."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            row = {c: left.column(c)[0] for c in ("batch", "ids", "sizes", "text")}
            plain, hot = (np.concatenate([_from_six(x.as_buffer()) for x in right.column(c)]) for c in ("hashes", "hot"))
            wanted = np.unique(np.concatenate([plain, hot]))
            ids, at, data = _opened(row)
            start, count, h, doc = _all_pieces(at, data, least)
            k = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            hit = wanted[k] == h
            start, count, h, doc = start[hit], count[hit], h[hit], doc[hit]
            start, count, h, doc = _one_by_one(data, start, count, h, doc, np.isin(h, hot), least)
            batch = row["batch"].as_py()
            bucket = first_bucket + (h % np.uint64(n_buckets)).astype(np.int64)
            raw = data.tobytes()
            number = np.zeros(len(h), np.int64)  # of an occurrence's piece within its bucket
            lowest = np.zeros(len(h), np.int64)
            by = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[by], np.unique(bucket))
            for rows in np.split(by, edge[1:]) if len(by) else []:
                seen: dict[bytes, int] = {}
                own = np.empty(len(rows), np.int64)
                for i, (s, c) in enumerate(zip(start[rows].tolist(), count[rows].tolist(), strict=True)):
                    own[i] = seen.setdefault(raw[s : s + c - 1 + least], len(seen))
                low, high = np.full(len(seen), np.iinfo(np.int64).max), np.full(len(seen), np.iinfo(np.int64).min)
                np.minimum.at(low, own, ids[doc[rows]])
                np.maximum.at(high, own, ids[doc[rows]])
                number[rows], lowest[rows] = own, low[own]
                sizes = np.fromiter(map(len, seen), "<u2", len(seen))
                out.append((batch, int(bucket[rows[0]]), _codec(len(seen).to_bytes(8, "little") + sizes.tobytes() + low.tobytes() + high.tobytes() + b"".join(seen))))
            where = np.stack([np.diff(start, prepend=0), count, bucket, number, (ids[doc] > lowest).astype(np.int64)])
            out.append((batch, -1 - batch, _codec(where.astype("<i4").tobytes())))
            trim()
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("batch", "bucket", "body"), columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)})

    return batches.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(run, "batch long, bucket long, body binary")


def _masks(parts: DataFrame, least: int) -> DataFrame:
    """(batch, bucket, body): of each piece of a batch, two masks of its windows: which of them a document has that is
    smaller than the batch's least with the piece, and which of them two documents have, so that any other document
    with the piece loses them. Equal pieces of several batches are expanded once, with the least and the largest
    document of all; intervals alone decide. Buckets below 0 go through as they are."""

    def run(key: tuple, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key[0].as_py() < 0:
            yield from (batch.select(["batch", "bucket", "body"]) for batch in source)
            return
        seen: dict[bytes, int] = {}
        names, number, own, low, high = [], [], [], [], []
        for batch in source:
            for k in range(batch.num_rows):
                raw = _plain(batch.column("body")[k].as_buffer()).tobytes()
                n = int.from_bytes(raw[:8], "little")
                at = 8 + 18 * n
                ends = at + np.cumsum(np.frombuffer(raw, "<u2", n, 8).astype(np.int64))
                names.append(batch.column("batch")[k].as_py())
                number.append(n)
                low.append(np.frombuffer(raw, "<i8", n, 8 + 2 * n))
                high.append(np.frombuffer(raw, "<i8", n, 8 + 10 * n))
                for e in ends.tolist():
                    own.append(seen.setdefault(raw[at:e], len(seen)))
                    at = e
        own, low, high = np.array(own, np.int64), np.concatenate(low), np.concatenate(high)
        first, last = np.full(len(seen), np.iinfo(np.int64).max), np.full(len(seen), np.iinfo(np.int64).min)
        np.minimum.at(first, own, low)
        np.maximum.at(last, own, high)
        size = np.fromiter(map(len, seen), np.int64, len(seen))
        text = np.frombuffer(b"".join(seen), np.uint8)
        count = size - least + 1
        piece = np.repeat(np.arange(len(size)), count)
        inner = spread(np.zeros(len(size), np.int64), count)
        lowest, several = lowest_documents(text, (np.cumsum(size) - size)[piece] + inner, first[piece], last[piece], least)
        bit = np.uint32(1) << inner.astype(np.uint32)
        both = np.bitwise_or.reduceat(np.where(several, bit, 0).astype(np.uint32), np.cumsum(count) - count)
        # a piece's windows as its own batch sees them: smaller than the batch's least document with it
        entry = np.repeat(np.arange(len(own)), count[own])
        at = spread((np.cumsum(count) - count)[own], count[own])
        under = np.where(several[at] & (lowest[at] < low[entry]), bit[at], 0).astype(np.uint32)
        masks = np.stack([np.bitwise_or.reduceat(under, np.cumsum(count[own]) - count[own]), both[own]]).astype("<u4")
        edge = np.concatenate([[0], np.cumsum(number)])
        del seen, text, piece, inner, lowest, several, entry, at, under
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([key[0].as_py()] * len(names), pa.int64()), pa.array([masks[:, a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], ["batch", "bucket", "body"])

    return parts.groupBy("bucket").applyInArrow(run, "batch long, bucket long, body binary")


def covered(marks: np.ndarray, least: int) -> np.ndarray:
    """Bytes that lie in a marked window; marks[i]: the window that begins at i."""
    total = np.concatenate([np.zeros(least, np.int64), np.cumsum(marks)])
    return total[least:] > total[:-least]


def _cut(batches: DataFrame, masks: DataFrame, least: int, like: StructType | None = None) -> DataFrame:
    """What is left of documents of which something goes; with `like`, a documents' schema, all rows of the batches
    with the texts that are left."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        kept_of: dict[int, str] = {}
        where = [b for k, b in zip(right.column("bucket").to_pylist(), right.column("body"), strict=True) if k < 0]
        if left.num_rows and where:
            ids, at, data = _opened({c: left.column(c)[0] for c in ("ids", "sizes", "text")})
            rounds = [np.frombuffer(_plain(b.as_buffer()), "<i4").reshape(5, -1).astype(np.int64) for b in where]
            start, _, bucket, number, later = np.concatenate([np.stack([np.cumsum(x[0]), *x[1:]]) for x in rounds], 1)
            mask = np.zeros(len(start), np.uint64)
            by = np.argsort(bucket, kind="stable")
            ordered = bucket[by]
            for b, m in zip(right.column("bucket").to_pylist(), right.column("body"), strict=True):
                if b >= 0:
                    rows = by[np.searchsorted(ordered, b) : np.searchsorted(ordered, b, "right")]
                    masks = np.frombuffer(m.as_buffer(), "<u4").reshape(2, -1)
                    mask[rows] = masks[later[rows], number[rows]]  # a later document of the batch loses what two have
            some = np.nonzero(mask)[0]
            mask, start = mask[some], start[some]
            marks = np.zeros(len(data), bool)
            for k in range(PIECE):  # the k-th windows of all pieces
                marks[start[(mask >> np.uint64(k) & np.uint64(1)) > 0] + k] = True
            for i in np.unique(np.searchsorted(at, np.nonzero(marks)[0], "right") - 1).tolist():
                text, gone = data[at[i] : at[i + 1]], covered(marks[at[i] : at[i + 1]], least)
                kept = text[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                if like is None:
                    out.append((int(ids[i]), len(text), hashlib.sha256(text).digest(), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
                else:
                    kept_of[i] = kept.decode("utf-8", "ignore")
        if like is not None:
            return carried(left, kept_of)
        trim()
        kinds = {"d": pa.int64(), "n": pa.int64(), "sig": pa.binary(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        return pa.table({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), columns, strict=True)})

    def carried(left: pa.Table, kept_of: dict[int, str]) -> pa.Table:
        arrow = to_arrow_schema(like)
        if not left.num_rows:
            return arrow.empty_table()
        ids, at, data = _opened({c: left.column(c)[0] for c in ("ids", "sizes", "text")})
        others = pa.ipc.open_stream(left.column("rows")[0].as_buffer()).read_all()
        texts = [kept_of[i] if i in kept_of else str(data[at[i] : at[i + 1]].data, "utf-8") for i in range(len(ids))]
        table = pa.table({f.name: pa.array(texts, f.type) if f.name == "text" else others.column(f"c_{f.name}").cast(f.type) for f in arrow})
        trim()
        return table.filter(pa.array([kept_of.get(i) != "" for i in range(len(ids))]))  # what was emptied goes

    schema = like if like is not None else "d long, n long, sig binary, n_removed long, n_spans long, kept_sha256 string"
    return batches.groupBy("batch").cogroup(masks.groupBy("batch")).applyInArrow(run, schema)


def _kept_by_batch(batches: DataFrame, n_bytes: int) -> tuple[DataFrame, int]:
    """The batches as a table that is bucketed by batch, about half a batch to a bucket, in the shared folder, so that
    no later step shuffles texts; and the bytes of their texts."""
    spark = batches.sparkSession
    path = scratch(spark, "batches")
    name = path.rpartition("/")[2].replace("-", "_")
    n_buckets = min(MOST_BUCKETS, max(16, 2 * n_bytes // BATCH_BYTES))
    batches.write.option("path", path).option("compression", "none").bucketBy(n_buckets, "batch").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone; the files are external and the frame knows them
    return table, int(table.agg(F.sum("volume")).first()[0] or 0)


def _found(docs: DataFrame, least: int, carry: bool, hot: int = HOT_BATCHES) -> tuple[DataFrame, DataFrame]:
    """The packed texts, and for the pieces that documents share where they are and which of their windows a smaller
    document has."""
    if least < 4:
        raise ValueError("the least length is 4 bytes")
    n_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    batches, size = _kept_by_batch(_batches(docs, carry), n_bytes)
    n_rounds = min(ROUNDS, 1 + size // ROUND_BYTES)
    n_hash = max(8, size // 3 // HASH_BYTES)
    with recorded() as folders:
        shared = written(_shared(_hashes(batches, least, n_hash), hot), "shared")
    # the share of hashes that two documents have grows with the table, and a hot one has a piece for each window
    weight = shared.agg(F.sum((F.octet_length("hashes") + F.octet_length("hot") * PIECE).cast("long"))).first()[0] or 0
    n_piece = max(16, weight // 6 // PIECE_HASHES // n_rounds)
    masks = []
    for k in range(n_rounds):
        mine = shared.where(F.col("bucket") % n_rounds == k).drop("bucket")
        masks.append(written(_masks(_parted(batches, mine, least, n_piece, k * n_piece), least), "masks"))
    remove(docs.sparkSession, folders)
    return batches, reduce(DataFrame.unionByName, masks)


def repeats(docs: DataFrame, least: int = 50, hot: int = HOT_BATCHES) -> DataFrame:
    """Documents of which something goes, in one row for each of their texts: (d, n, sig, n_removed, n_spans,
    kept_sha256)."""
    return _cut(*_found(docs, least, False, hot), least).distinct()


def cleaned(docs: DataFrame, least: int = 50, hot: int = HOT_BATCHES) -> DataFrame:
    """The rows with what is left of their texts (column `text`), without a shuffle of texts.

    Characters of which only some bytes remain go too, and so do documents with nothing left. Rows with a null id or
    text stay as they are. Other columns pass through.
    """
    rest = docs.where(F.col("doc_id").isNull() | F.col("text").isNull())
    return _cut(*_found(docs, least, True, hot), least, docs.schema).unionByName(rest)


def dedup(docs: DataFrame, least: int = 50, hot: int = HOT_BATCHES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of the input.

    A byte goes if it lies in a string of `least` bytes that also begins in a document with a smaller id; strings are
    those of the input. Null texts are empty; texts shorter than `least` and rows with a null id keep all and remove
    nothing elsewhere. Rows of one id don't remove each other's bytes. Texts of any length are read whole; one longer
    than a batch is a batch of its own. Other columns are ignored. `hot`: batches that have a hash from which on its
    windows are dealt one by one; it changes the work's division alone.
    """
    gone = repeats(docs, least, hot)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    found = gone.select("d", F.lower(F.hex("sig")).alias("sig"), "n_removed", "n_spans", "kept_sha256")
    out = rows.join(found, (F.col("doc_id") == F.col("d")) & (F.col("whole") == F.col("sig")), "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
