"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

Codes are cut in m segments, each about as wide as the number of codes has bits, so that a key holds few codes
whatever the table's size. Two codes at distance d agree in some segment up to d // m; after all segments have been
searched up to radius r - 1 and the first a up to r, every code within m * r + a - 1 has been met. Rounds of growing
radius go on for those queries whose k-th verified distance isn't covered yet, over as many segments as it takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import scaled_partitions, written

#: Bits of a code, and of a segment, at most.
BITS, WIDEST = 64, 32


def sign_code(vector: str, dims: int = BITS) -> Column:
    """Code of a vector of `dims` components: bit i, from the highest of `dims`, is set if component i is above zero.

    Null for vectors that are null, empty or hold null or non-finite components. Another length is an error.
    """
    v = F.col(vector)
    one = F.transform(v, lambda x: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(one, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wrong = F.raise_error(F.format_string("a vector of %d components among those of %d", F.size(v), F.lit(dims))).cast("long")
    return F.when(finite & (F.size(v) > 0), F.when(F.size(v) == dims, code).otherwise(wrong))


def sign_codes(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, code) and the number of bits, which is the length of the vectors; over 64 is an error."""
    bits = table.agg(F.max(F.size(vector_column))).first()[0] or 0
    if bits > BITS:
        raise ValueError(f"vectors of {bits} components; codes have at most {BITS} bits")
    bits = max(1, bits)
    return table.select(F.col(id_column).alias("vec_id"), sign_code(vector_column, bits).alias("code")), bits


def widths(n: int, bits: int) -> list[int]:
    """Widths of the segments for n codes: about log2(n) bits each, as equal as they can be."""
    wide = min(WIDEST, max(1, int(n).bit_length()))
    m = max(1, min(bits, round(bits / wide)))
    return [(bits * (i + 1)) // m - (bits * i) // m for i in range(m)]


def segment(code: Column, start: int, width: int) -> Column:
    return F.call_function("shiftrightunsigned", code, F.lit(start)).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _segments(code: Column, sizes: list[int]) -> list[Column]:
    return [segment(code, sum(sizes[:i]), w) for i, w in enumerate(sizes)]


def _masked(probes: DataFrame, radius: int, sizes: list[int]) -> DataFrame:
    """A row for each mask of `radius` bits within the probe's segment: one more bit, above the last, in each step."""
    width = F.element_at(F.array(*map(F.lit, sizes)), F.col("seg") + 1)
    rows = probes.withColumn("mask", F.lit(0).cast("long")).withColumn("top", F.lit(-1))
    for left in range(radius, 0, -1):
        rows = rows.where(F.col("top") + left < width).withColumn("top", F.explode(F.sequence(F.col("top") + 1, width - left)))
        rows = rows.withColumn("mask", F.col("mask").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("top"))))
    return rows.drop("top")


def search(codes: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", code_column: str = "code", bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, distance): each query's k nearest codes but its own row, ties to the smaller id.

    Exact: all candidates if there are fewer than k. Rows with a null id or code take no part; repeated rows of an
    id count once, and an id with several codes takes part with each of them, in a row each. Of equal codes only the k + 1 smallest
    ids can be in any result, so the others leave the index before it is built, however many they are. Codes have
    `bits` bits. Each round reads the open queries alone, spread over all tasks, looks for codes no farther than the
    k-th so far, and writes the best to the shared folder. A key that many codes share is split by the planner, which
    joins by merging. Other columns are ignored.
    """
    spark = codes.sparkSession
    rows = codes.select(F.col(id_column).cast("long").alias("vec_id"), F.col(code_column).cast("long").alias("code")).dropna().distinct()
    nth = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    index = written(rows.withColumn("_n", nth).where(F.col("_n") <= k + 1).drop("_n"), "index")
    sizes = widths(index.count(), bits)
    m = len(sizes)
    # each code under its key in each segment
    keys = F.array(*[F.struct(F.lit(i).alias("seg"), key.alias("key")) for i, key in enumerate(_segments(F.col("code"), sizes))])
    by_segment = written(index.select("vec_id", "code", F.explode(keys).alias("at")).select("vec_id", "code", "at.seg", "at.key"), "codes")
    asked = queries.select(F.col(id_column).cast("long").alias("query_id"), F.col(code_column).cast("long").alias("query")).dropna().distinct()
    open_ = written(asked.withColumn("bound", F.lit(bits)), "queries")
    best, done = None, None
    order = Window.partitionBy("query_id", "query").orderBy("distance", "vec_id")
    between = F.col("query").bitwiseXOR(F.col("code"))
    apart = [F.bit_count(x).cast("int") for x in _segments(between, sizes)]
    parts = scaled_partitions(spark)
    for r in range(max(sizes) + 1):
        # as many segments as it takes to cover the k-th distance so far
        needed = F.least(F.lit(m), F.col("bound") - m * r + 1)
        probes = open_.select("*", F.explode(F.sequence(F.lit(0), needed - 1)).alias("seg")).repartition(parts, "query_id", "seg")
        own = F.element_at(F.array(*_segments(F.col("query"), sizes)), F.col("seg") + 1)
        probes = _masked(probes, r, sizes).select("query_id", "query", "bound", "seg", own.bitwiseXOR(F.col("mask")).alias("key"))
        # a pair counts where it is met first: no segment is nearer than r, and none before this one as near
        first = F.lit(True)
        for i, d in enumerate(apart):
            first &= d >= F.when(F.col("seg") > i, r + 1).otherwise(r)
        distance = F.bit_count(between).cast("int")
        # planners take an explode for a small table; both sides are dealt by segment and key
        met = probes.hint("merge").join(by_segment, ["seg", "key"]).where((F.col("vec_id") != F.col("query_id")) & (distance <= F.col("bound")) & first)
        found = met.select("query_id", "query", "vec_id", distance.alias("distance"))
        if best is not None:
            found = found.unionByName(best.join(open_.select("query_id", "query"), ["query_id", "query"], "left_semi"))
        best = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), f"radius{r}")
        kth = best.groupBy("query_id", "query").agg(F.max("distance").alias("far"), F.count("*").alias("n"))
        state = open_.drop("bound").join(kth, ["query_id", "query"], "left").withColumn("bound", F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(bits)))
        open_now = state.where((F.col("bound") > m * (r + 1) - 1) & (F.col("n").isNull() | (F.col("n") < k) | (F.col("far") > m * (r + 1) - 1)))
        still = written(open_now.select("query_id", "query", "bound"), f"open{r}")
        result = best.join(still.select("query_id", "query"), ["query_id", "query"], "left_anti")
        done = result if done is None else done.unionByName(result)
        if still.isEmpty() or r == max(sizes):
            done = done if still.isEmpty() else done.unionByName(best.join(still.select("query_id", "query"), ["query_id", "query"], "left_semi"))
            break
        open_ = still
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return done.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
