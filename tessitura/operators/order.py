"""Order statistics of groups of any size, exact, with memory that does not grow.

A double becomes 64 bits that sort as it does. All wanted ranks of all groups
descend together: rows are counted by their leading 16 bits, which combine
before the shuffle; a rank lies in the digit that its running count reaches, and
the next pass counts the next digit of only those rows that share this prefix.
Four passes fix every bit. No task sees more of a group than counts of 65,536
digits, however many values or copies of one value it has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..plans.checkpoints import checkpoint

DIGIT = 16
PASSES = 64 // DIGIT


@F.pandas_udf(LongType())
def sortable_bits(x: pd.Series) -> pd.Series:
    """Longs that sort, as unsigned numbers, as the doubles do; NaN last."""
    bits = (x.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))))


@F.pandas_udf(DoubleType())
def from_sortable_bits(x: pd.Series) -> pd.Series:
    bits = x.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(-(2**63)), ~bits).view(np.float64))


def _digit(bits: Column, k: int) -> Column:
    return F.shiftrightunsigned(bits, 64 - DIGIT * (k + 1)).bitwiseAND(F.lit((1 << DIGIT) - 1))


def values_at(rows: DataFrame, by: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """(by, rank, value): the value with so many values of its group before it.

    ``ranks``: distinct (by, rank), ranks from 0. Null values don't count; ranks
    that a group does not have are left out; ``by`` may be empty.
    """
    one = {"_all": F.lit(0)} if not by else {}
    keys = by or ["_all"]
    bits = checkpoint(rows.where(F.col(value).isNotNull()).withColumns(one).select(*keys, sortable_bits(F.col(value).cast("double")).alias("_bits")))
    found = ranks.withColumns(one).select(*keys, "rank", F.col("rank").cast("long").alias("_left"), F.lit(0).cast("long").alias("_prefix"))
    for k in range(PASSES):
        prefix = F.shiftrightunsigned("_bits", 64 - DIGIT * k) if k else F.lit(0).cast("long")
        rest = bits.withColumn("_prefix", prefix)
        if k:  # of the rest, only what a rank may still be
            rest = rest.join(found.select(*keys, "_prefix").distinct(), [*keys, "_prefix"], "left_semi")
        counts = rest.groupBy(*keys, "_prefix", _digit(F.col("_bits"), k).alias("_digit")).agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*keys, "_prefix").orderBy("_digit"))
        reached = counts.withColumn("_upto", upto).join(found, [*keys, "_prefix"]).where((F.col("_left") < F.col("_upto")) & (F.col("_left") >= F.col("_upto") - F.col("_n")))
        found = checkpoint(
            reached.select(*keys, "rank", (F.col("_left") - (F.col("_upto") - F.col("_n"))).alias("_left"), F.shiftleft("_prefix", DIGIT).bitwiseOR(F.col("_digit")).alias("_prefix"))
        )
    return found.select(*by, "rank", from_sortable_bits("_prefix").alias("value"))


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """(by, n, quantiles): the quantiles in the order of ``shares``, between
    neighbours in proportion, as :func:`F.percentile` gives them, and the number
    of values. Groups without values are left out."""
    one = {"_all": F.lit(0)} if not by else {}
    keys = by or ["_all"]
    rows = rows.withColumns(one)
    sizes = checkpoint(rows.groupBy(*keys).agg(F.count(value).alias("n")).where("n > 0"))
    want = sizes.select(*keys, "n", F.posexplode(F.array(*map(F.lit, shares))).alias("_k", "_share")).withColumn("_at", (F.col("n") - 1) * F.col("_share"))
    want = want.withColumn("_low", F.floor("_at")).withColumn("_high", F.ceil("_at"))
    ranks = want.select(*keys, F.explode(F.array("_low", "_high")).alias("rank")).distinct()
    at = values_at(rows, keys, value, ranks)
    both = want.join(at.withColumnsRenamed({"rank": "_low", "value": "_a"}), [*keys, "_low"]).join(at.withColumnsRenamed({"rank": "_high", "value": "_b"}), [*keys, "_high"])
    x = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.col("_high") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.col("_low")) * F.col("_b"))
    packed = both.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("_k", x.alias("x")))).alias("_q"))
    return packed.select(*by, "n", F.col("_q.x").alias("quantiles"))


def exact_median(rows: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """(by, name)."""
    return exact_quantiles(rows, by, value, (0.5,)).select(*by, F.col("quantiles")[0].alias(name))
