"""Series in long form: one row per point with a key, an order, and a value that is null where it is missing."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.functions.elementwise import finite


@dataclass(frozen=True)
class Series:
    """Rows of many series. `key` columns name a series, `order` columns its order, `value` the numbers.

    Columns that operators add begin with the names they document; other columns pass through.
    """

    df: DataFrame
    key: tuple[str, ...]
    order: tuple[str, ...]
    value: str = "value"

    @staticmethod
    def of(df: DataFrame, key, order, value: str = "value") -> Series:
        """NaN and infinities become null in column `x`; the raw column stays."""
        as_tuple = lambda c: (c,) if isinstance(c, str) else tuple(c)
        missing = [c for c in (*as_tuple(key), *as_tuple(order), value) if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        return Series(df.withColumn("x", finite(F.col(value))), as_tuple(key), as_tuple(order), value)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.key).orderBy(*self.order)

    def frame(self, before: int, after: int) -> WindowSpec:
        return self.window().rowsBetween(-before, after)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.key)

    def having(self, df: DataFrame) -> Series:
        return replace(self, df=df)

    def indexed(self) -> Series:
        """Adds `idx`, the place in the series from 0."""
        return self.having(self.df.withColumn("idx", (F.row_number().over(self.window()) - 1).cast("long")))


def values(over: WindowSpec, column: str = "x") -> Column:
    """Array of the frame's values that aren't missing."""
    return F.collect_list(F.col(column)).over(over)


def with_double(schema: StructType, name: str) -> StructType:
    """The schema and one more column (StructType.add would change the DataFrame's own)."""
    return StructType([*schema.fields, StructField(name, DoubleType())])


def in_blocks(series: Series, index: str, reach: int, rows: int = 1_000_000) -> Series:
    """Cuts long series into blocks of `rows` points that windows can process apart.

    `index` counts the points of a series from 0 without gaps. Points within `reach` of a border are copied to the
    next block; `own_rows` drops the copies afterwards. Frames of up to `reach` rows to either side give what they
    give on the whole series, so that a single giant series is spread over many tasks.
    """
    if rows <= reach:
        raise ValueError("blocks must be longer than the reach")
    at = F.col(index)
    blocks = F.sequence(F.floor(F.greatest(at - reach, F.lit(0)) / rows), F.floor((at + reach) / rows))
    df = series.df.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == F.floor(at / rows))
    return replace(series, df=df, key=(*series.key, "_block"))


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_block")
