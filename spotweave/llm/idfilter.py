"""A Bloom filter of ids of bounded size, to keep rows that can't match out of a shuffle. It decides nothing: exact joins follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: At most 2**20 words of 64 bits; about 16 bits an id. Beyond that it lets more rows pass.
LEAST_BITS, MOST_BITS = 1 << 19, 1 << 26


def mark(df: DataFrame, by: str, ids: DataFrame, column: str, n: int, out: str) -> DataFrame:
    """df with the boolean column out, false only where `by` is not among `column` of ids (n rows); NULL is never among them.

    The bits are words in a table of at most MOST_BITS / 64 rows, which is broadcast.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, 16 * n) - 1).bit_length()))

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))

    one = F.expr("shiftleft(1L, cast(__place & 63 as int))")
    words = ids.filter(F.col(column).isNotNull()).select(place(column).alias("__place"))
    words = materialize(words.groupBy(F.shiftright("__place", 6).alias("__word")).agg(F.bit_or(one).alias("__bits")), "idfilter")
    placed = df.withColumn("__place", F.when(F.col(by).isNotNull(), place(by)))
    joined = placed.join(F.broadcast(words), F.shiftright("__place", 6) == F.col("__word"), "left")
    return joined.withColumn(out, F.coalesce(F.col("__bits").bitwiseAND(one) != 0, F.lit(False))).drop("__place", "__word", "__bits")
