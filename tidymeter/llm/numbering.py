"""Gapless numbers inside each value of a key, without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SALT_ROWS = 200_000


def numbered(df: DataFrame, key: str, total: int, out: str, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... inside each value of ``key``, in no promised order.

    Rows of a key are dealt to salts by a hash of the whole row; a count per
    (key, salt) says where a salt begins, a row number goes on inside it. Equal
    rows stay in one salt. ``total`` is the number of rows, ``df`` is read twice.
    """
    salts = max(8, total // salt_rows)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(key, "_salt").count().select(
        key, "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first")
    )
    inside = Window.partitionBy(key, "_salt").orderBy(F.xxhash64(*df.columns))
    ranked = salted.withColumn("_n", F.row_number().over(inside)).join(starts, [key, "_salt"])
    return ranked.select(*df.columns, (F.col("_first") + F.col("_n") - 1).alias(out))
