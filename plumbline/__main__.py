"""python -m plumbline [--json] FILE | NUMBER...: flags anomalies of a series of numbers."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.functions.windows import Series
from plumbline.operators.trigger import Shield
from plumbline.sources.readers import numbers


def main(argv: list[str] | None = None) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    as_json = "--json" in args
    args = [a for a in args if a != "--json"]
    if not args:
        print(__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    if len(args) == 1 and os.path.exists(args[0]):
        df = numbers(spark, f"file://{os.path.abspath(args[0])}").withColumn("series", F.lit(os.path.basename(args[0])))
    else:
        df = spark.createDataFrame([("series", i, float(v)) for i, v in enumerate(args)], "series string, idx long, value double")
    s = Series.of(df.withColumnRenamed("idx", "at"), "series", "at")
    column, table = ("json", Shield().report(s)) if as_json else ("summary", Shield().summary(s))
    for row in table.select(column).collect():
        print(row[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
