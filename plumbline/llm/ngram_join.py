"""N-gram Jaccard self-join by a blocked sparse product of the document by shingle incidence.

Shingles are taken in an order from seldom to frequent, which a fixed-size count table gives. Two documents that
link share a shingle among their first n - ceil(0.8 n) + 1. Documents that share one are brought together under the
list's least document; their incidence rows are multiplied there in blocks, and pairs that the sizes rule out are
left aside. Links become components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, blocks, looked_up, mixed, trim, written
from plumbline.llm.components import components
from plumbline.llm.shingles import shingle_sets
from plumbline.runtime import recorded, remove

#: Least and most entries of the count table. It only orders shingles, so collisions cost time and no result.
TABLE = (1 << 20, 1 << 26)
SLICE = 1 << 16
#: Documents of one block of a product, and bytes of entries that one task sorts.
BLOCK, TASK_BYTES = 2048, 4 << 20
#: Documents of one part of a list, and digests of sets that a task remembers.
PART, SEEN = 1 << 12, 1 << 16


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    at, data = as_bytes(batch.column("t"))
    for i, j in blocks(at):
        h, s = shingle_sets(at[i : j + 1], data, words)
        yield i, h, s


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("t"))


def table_size(n_bytes: int) -> int:
    """A power of two with about eight shingles to an entry, within the bounds."""
    return min(TABLE[1], max(TABLE[0], 1 << int(n_bytes // 48).bit_length()))


def _scan(docs: DataFrame, words: int, size: int) -> DataFrame:
    """Rows of documents (doc_id, n, sig: digest of the set), and rows of counts (slice, counts) of each partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.uint8)  # counts up to 255
        for batch in batches:
            for i, h, s in _sets(batch, words):
                n = np.diff(s)
                at, times = np.unique(h & np.uint64(size - 1), return_counts=True)
                table[at] = np.minimum(table[at] + times, 255)
                sigs = [hashlib.md5(h[a:b].tobytes()).digest() for a, b in zip(s[:-1].tolist(), s[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(n)), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        k = size // SLICE
        for i in range(0, k, 64):
            parts = [pa.compress(table[j * SLICE : (j + 1) * SLICE].tobytes(), "zstd", asbytes=True) for j in range(i, min(k, i + 64))]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.binary()), pa.array(range(i, i + len(parts)), pa.int32()), pa.array(parts, pa.binary())], names)

    names = ["doc_id", "n", "sig", "slice", "counts"]
    return _texts(docs).mapInArrow(run, "doc_id long, n long, sig binary, slice int, counts binary")


def _levels(scanned: DataFrame, size: int, total: int) -> np.ndarray:
    """Frequency level, a byte, of each entry of the count table; a task's counts above 255 count as 255."""
    usual = total / size

    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLICE, np.int64)
        for batch in batches:
            for c in batch.column("counts"):
                counts += np.frombuffer(pa.decompress(c.as_buffer(), SLICE, "zstd"), np.uint8)
        level = np.minimum(255, np.floor(12 * np.log2(1 + counts / (usual + 1)))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["slice", "level"])

    out = np.zeros(size, np.uint8)
    for r in scanned.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(added, "slice int, level binary").collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["level"], np.uint8)
    return out


def list_parts(size: int, total: int) -> np.ndarray:
    """Parts of the list of a shingle by its level: 1, and more as its entry goes beyond what collisions explain."""
    usual = total / size
    count = (2 ** (np.arange(256) / 12) - 1) * (usual + 1)
    return 1 + np.maximum(0, count - 16 * usual).astype(np.int64) // PART


def first_shingles(h: np.ndarray, s: np.ndarray, level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in h of each set's first shingles, seldom ones first, and the set of each."""
    n = np.diff(s)
    row = np.repeat(np.arange(len(n)), n)
    seldom = level[(h & np.uint64(len(level) - 1)).astype(np.int64)]
    by = np.lexsort((mixed(h), seldom, row))
    rank = np.arange(len(h)) - np.repeat(s[:-1], n)
    take = rank < np.repeat(n + (-n * percent // 100) + 1, n)  # n - ceil(n * percent / 100) + 1
    return by[take], row[take]


ENTRY = np.dtype([("h", "<u8"), ("doc", "<i8"), ("n", "<u4"), ("sig", "<u8")])


def _in_bands(e: np.ndarray, parts: np.ndarray, percent: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of long lists and their buckets, from n_buckets on. Two sets that can link are of one class of sizes or
    of neighbouring ones, so each entry goes to two bands, whose lists have keys of their own; a band is dealt in parts
    by the sets' digests, so equal sets still meet."""
    size_class = (np.floor(np.log(e["n"]) / np.log(100 / percent) + 1e-9) if percent < 100 else e["n"]).astype(np.uint64)
    both = np.concatenate([e, e])
    band = np.concatenate([size_class, size_class + np.uint64(1)])
    both["h"] = mixed(both["h"] + mixed(band + np.uint64(1)))
    part = mixed(both["sig"]) % np.concatenate([parts, parts]).astype(np.uint64)
    return both, n_buckets + (mixed(both["h"] + mixed(part + np.uint64(1))) % np.uint64(n_buckets)).astype(np.int64)


def _entries(docs: DataFrame, words: int, percent: int, levels, parts_of: np.ndarray, n_buckets: int) -> DataFrame:
    """(bucket, entries): first shingles of documents, packed. Of equal sets that a task remembers only ids that fall
    are kept, so a class of copies has few entries. Buckets from n_buckets on have parts of long lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        seen: dict[bytes, int] = {}

        def falls(digest: bytes, doc: int) -> bool:
            if seen.get(digest, doc + 1) <= doc:
                return False
            if len(seen) >= SEEN:
                seen.clear()
            seen[digest] = doc
            return True

        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            held: list[np.ndarray] = []
            for i, h, s in _sets(batch, words):
                n = np.diff(s)
                at, row = first_shingles(h, s, level, percent)
                digests = [hashlib.md5(h[a:b].tobytes()).digest() for a, b in zip(s[:-1].tolist(), s[1:].tolist(), strict=True)]
                sig = np.array([int.from_bytes(d[:8], "little") for d in digests], np.uint64)
                take = np.array([k and falls(d, x) for k, d, x in zip(known[i : i + len(n)].tolist(), digests, ids[i : i + len(n)].tolist(), strict=True)], bool)
                at, row = at[take[row]], row[take[row]]
                e = np.zeros(len(at), ENTRY)
                e["h"], e["doc"], e["n"], e["sig"] = h[at], ids[i + row], n[row], sig[row]
                held.append(e)
            if not held:
                continue
            e = np.concatenate(held)
            parts = parts_of[level[(e["h"] & np.uint64(len(level) - 1)).astype(np.int64)]]
            banded, theirs = _in_bands(e[parts > 1], parts[parts > 1], percent, n_buckets)
            e = e[parts == 1]
            bucket = np.concatenate([(mixed(e["h"]) % np.uint64(n_buckets)).astype(np.int64), theirs])
            e = np.concatenate([e, banded])
            by = np.lexsort((e["doc"], e["sig"], e["h"], bucket))
            e, bucket = e[by], bucket[by]
            new = np.ones(len(e), bool)
            new[1:] = (e["h"][1:] != e["h"][:-1]) | (e["sig"][1:] != e["sig"][:-1]) | (e["n"][1:] != e["n"][:-1])
            e, bucket = e[new], bucket[new]
            cut = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(bucket)]])
            if len(e):
                # columns one after the other, which compresses better than rows
                parts = [b"".join(e[c][a:b].tobytes() for c in ENTRY.names) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]], pa.int64()), pa.array(parts, pa.binary())], ["bucket", "entries"])

    return _texts(docs).mapInArrow(run, "bucket long, entries binary")


def _unpacked(raw: pa.Buffer) -> np.ndarray:
    n, at = len(raw) // ENTRY.itemsize, 0
    e = np.zeros(n, ENTRY)
    for c in ENTRY.names:
        e[c] = np.frombuffer(raw, ENTRY[c], n, at)
        at += n * ENTRY[c].itemsize
    return e


def _met(entries: DataFrame, percent: int, n_buckets: int) -> DataFrame:
    """(leader, doc): documents that share a first shingle, under the least by hash of those that share it.

    A document is left out of a list if no other one there is of a size that could link. Parts of a long list have
    leaders of their own first, of which the least by hash leads them all; no task sorts the whole of such a list.
    """
    names = ["list", "weight", "leader", "doc"]

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpacked(x.as_buffer()) for batch in batches for x in batch.column("entries")]
        e = np.concatenate(held)
        by = np.lexsort((e["doc"], e["sig"], e["n"], e["h"]))
        e = e[by]
        new = np.ones(len(e), bool)
        new[1:] = (e["h"][1:] != e["h"][:-1]) | (e["sig"][1:] != e["sig"][:-1]) | (e["n"][1:] != e["n"][:-1])
        e = e[new]  # in order of size within a list
        n = e["n"].astype(np.int64)
        same = e["h"][1:] == e["h"][:-1]
        near = same & (100 * n[:-1] >= percent * n[1:])
        near = np.concatenate([[False], near, [False]])
        long = key[0].as_py() >= n_buckets
        if long:  # sets of other parts may be near
            part = np.cumsum(np.concatenate([[True], ~same]))
        else:
            keep = near[1:] | near[:-1]
            # a gap in sizes that no pair can cross cuts a list in two
            part = np.cumsum(~near[:-1])[keep]
            e = e[keep]
        lists, leaders, docs = (np.zeros(0, np.int64) for _ in range(3))
        if len(e):
            weight = mixed(e["doc"].astype(np.uint64))
            by = np.lexsort((weight, part))
            part, doc = part[by], e["doc"][by]
            first = np.concatenate([[0], np.nonzero(np.diff(part))[0] + 1])
            leader = np.repeat(doc[first], np.diff(np.append(first, len(doc))))
            of = e["h"][by].view(np.int64) if long else np.zeros(len(doc), np.int64)
            lists, leaders, docs = np.unique(np.stack([of, leader, doc], 1), axis=0).T
        del e, held
        trim()
        weights = (mixed(leaders.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
        none = np.full(len(docs), not long)
        yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64(), mask=none), pa.array(weights, pa.int64(), mask=none), pa.array(leaders, pa.int64()), pa.array(docs, pa.int64())], names)

    found = written(entries.groupBy("bucket").applyInArrow(run, "list long, weight long, leader long, doc long"), "lists")
    parts = found.where("list is not null")
    heads = parts.groupBy("list").agg(F.min_by("leader", F.struct("weight", "leader")).alias("head"), F.count("*").alias("docs"))
    met = looked_up(parts, written(heads.where("docs > 1"), "heads"), "list", max(1, parts.count()), "docs")
    led = met.where("head is not null").select(F.col("head").alias("leader"), "doc")
    return found.where("list is null").select("leader", "doc").unionByName(led).distinct()


def links(h: np.ndarray, s: np.ndarray, percent: int, halves: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (given end to end) that link. halves: only pairs of which one is marked and one isn't."""
    k, n = len(s) - 1, np.diff(s)
    owner = np.repeat(np.arange(k), n)
    by = np.argsort(h, kind="stable")
    h, owner = h[by], owner[by]
    first = np.concatenate([[0], np.nonzero(np.diff(h))[0] + 1]) if len(h) else np.zeros(0, int)
    size = np.diff(np.append(first, len(h)))
    shared = np.repeat(size > 1, size)
    owner, size = owner[shared], size[size > 1]
    if not size.size:
        return np.zeros(0, int), np.zeros(0, int)
    column = np.repeat(np.arange(len(size)), size)
    if int((size * size).sum()) <= 4_000_000 and k <= 2000:
        # overlap counts of all pairs within each column
        start = np.repeat(np.cumsum(size) - size, size)
        count = np.repeat(size, size)
        left = np.repeat(owner, count)
        right = owner[np.repeat(start, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)]
        overlap = np.bincount(left * k + right, minlength=k * k).reshape(k, k)
        a, b = np.nonzero(((100 + percent) * overlap >= percent * (n[:, None] + n[None])) & (overlap > 0))
    else:
        found = []
        order = np.argsort(owner, kind="stable")
        owner, column = owner[order], column[order]
        edge = np.searchsorted(owner, np.arange(k + 1))
        for i in range(0, k, 256):
            e = min(k, i + 256)
            mine = slice(edge[i], edge[e])
            used, local = np.unique(column[mine], return_inverse=True)
            at = np.full(len(size), -1)
            at[used] = np.arange(len(used))
            dense = np.zeros((e - i, len(used)), np.float32)
            dense[owner[mine] - i, local] = 1
            for j in range(i, k, 256):
                f = min(k, j + 256)
                theirs = slice(edge[j], edge[f])
                c = at[column[theirs]]
                other = np.zeros((f - j, len(used)), np.float32)
                other[owner[theirs][c >= 0] - j, c[c >= 0]] = 1
                overlap = dense @ other.T
                x, y = np.nonzero(((100 + percent) * overlap >= percent * (n[i:e, None] + n[None, j:f])) & (overlap > 0))
                found.append((x + i, y + j))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    up = a < b
    a, b = a[up], b[up]
    if halves is not None:
        across = halves[a] != halves[b]
        a, b = a[across], b[across]
    return a, b


def _joined(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Least index of each one's component."""
    up = list(range(k))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return np.array([top(x) for x in range(k)])


def _products(members: DataFrame, words: int, percent: int, n_groups: int) -> DataFrame:
    """(a, b): links that join the documents of each unit (leader, i, j); a unit's rows come with their texts."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("leader", "ascending"), ("i", "ascending"), ("j", "ascending"), ("doc", "ascending")]).combine_chunks()
        doc = table.column("doc").to_numpy()
        at, data = as_bytes(table.column("t"))
        sets = [shingle_sets(at[i : j + 1], data, words) for i, j in blocks(at)]
        h = np.concatenate([x for x, _ in sets])
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(s) for _, s in sets]))])
        unit = np.stack([table.column(c).to_numpy() for c in ("leader", "i", "j")], 1)
        half = table.column("half").to_numpy()
        cut = np.concatenate([[0], np.nonzero((unit[1:] != unit[:-1]).any(1))[0] + 1, [len(unit)]])
        left, right = [], []
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if y - x > 1:
                a, b = links(h[at[x] : at[y]], at[x : y + 1] - at[x], percent, half[x:y] if unit[x, 1] != unit[x, 2] else None)
                if len(a):
                    root = _joined(a, b, y - x)
                    own = np.nonzero(root != np.arange(y - x))[0]
                    left.append(doc[x:y][root[own]])
                    right.append(doc[x:y][own])
        left, right = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (left, right))
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    dealt = members.withColumn("group", F.pmod(F.xxhash64("leader", "i", "j"), F.lit(n_groups)))
    return dealt.groupBy("group").applyInArrow(run, "a long, b long")


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of the input.

    Documents link if 100 * intersection >= percent * union of their sets of distinct shingles; the component is
    the smallest id reachable. Texts of fewer words than a shingle have all of them as their one shingle; null and
    empty texts and texts of blanks have none and are their own component. Rows with equal sets form a class that
    takes part once, by its smallest id, so groups of copies cost one document however large they are. A row with a
    null id takes its class's component (null if the class has no id). Other columns are ignored. Of the tables on the
    way only the scan and the classes stay in the shared folder, which the result reads.
    """
    spark = docs.sparkSession
    n_bytes = docs.select(F.octet_length(F.col("text").cast("string")).alias("n")).agg(F.sum("n")).first()[0] or 0
    size = table_size(n_bytes)
    scanned = written(_scan(docs, words, size), "scan")
    rows = scanned.where("slice is null").select("doc_id", "n", "sig")
    facts = rows.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    total = facts["n"] or 0
    level = spark.sparkContext.broadcast(_levels(scanned, size, total))  # a byte an entry, TABLE[1] bytes at most
    parts_of = list_parts(size, total)
    n_buckets = max(16, int(total * (101 - percent) / 100) * ENTRY.itemsize // TASK_BYTES)
    with recorded() as folders:
        found = _met(_entries(docs, words, percent, level, parts_of, n_buckets), percent, n_buckets)
    with recorded() as met_folder:
        met = written(found, "met")
    remove(spark, folders)
    sizes = met.groupBy("leader").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK)
    blocks_ = met.join(sizes, "leader", "left").select("leader", "doc", F.ceil(F.coalesce("k", F.lit(1)) / BLOCK).cast("int").alias("n_blocks"))
    own = blocks_.withColumn("own", F.pmod(F.xxhash64("doc"), "n_blocks").cast("int"))
    # a block meets itself and each other block of its list once
    units = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "leader", "doc", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("half")
    )

    texts = _texts(docs).dropna(subset=["doc_id"])
    # one plan at every size: which documents are candidates is known by id alone, and both sides are dealt by it
    members = units.hint("merge").join(texts.withColumnRenamed("doc_id", "doc"), "doc")
    n_groups = max(16, met.count() // 500)
    edges = _products(members, words, percent, n_groups)
    with recorded() as folders:
        found = components(edges)
    reps = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(reps.join(found, F.col("rep") == F.col("node"), "left").select("sig", "copies", F.coalesce("component", "rep").alias("component_id")), "classes")
    remove(spark, [*folders, *met_folder])
    # rows without shingles are their own component
    out = looked_up(rows.where("n > 0"), classes, "sig", facts["rows"], "copies")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
