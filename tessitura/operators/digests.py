"""Digests of sets of ids, without a gathered list: order-free sums that subtract,
and the sha256 of the whole sorted list.

An id's sha256 is four limbs of 64 bits; a multiset's digest is the sum of each
limb over its members, with their number, modulo 2^64 when it is named. Sums
combine before the shuffle, and those of a training set are the total's less
the held-out fold's, so no group's ids ever meet in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMBS = 4
_MODULUS = "CAST(18446744073709551616 AS DECIMAL(38,0))"
SUMS = ["n", *(f"s{k}" for k in range(LIMBS))]


def limb(key: Column, k: int) -> Column:
    """The k-th 64 bits of an id's sha256, as a decimal."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")


def sums(key: str) -> list[Column]:
    """Aggregates ``n`` and ``s0`` to ``s3`` of a set's ids; null ids don't count."""
    return [F.count(key).alias("n"), *[F.coalesce(F.sum(limb(F.col(key), k)), F.lit(0)).cast("decimal(38,0)").alias(f"s{k}") for k in range(LIMBS)]]


def named(prefix: str = "") -> Column:
    """The digest, in hexadecimal, of the columns that :func:`sums` gives."""
    parts = [F.expr(f"CAST(pmod({prefix}s{k}, {_MODULUS}) AS STRING)") for k in range(LIMBS)]
    return F.sha2(F.concat_ws("|", F.col(f"{prefix}n").cast("string"), *parts), 256)


def set_digests(members: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, n, digest)."""
    return members.groupBy(*by).agg(*sums(key)).select(*by, "n", named().alias("digest"))


def list_digests(members: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, digest): sha256 of the ids as text, sorted and joined by commas; null
    ids don't count. A task sorts its groups' ids and hashes them as they pass."""
    rows = members.where(F.col(key).isNotNull()).select(*by, F.col(key).cast("string").alias("_id"))
    found = rows.select(*by, F.lit("").alias("digest")).schema

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for *at, key in zip(*(c.to_pylist() for c in batch.columns)):
                if at == group:
                    digest.update(b"," + key.encode())
                    continue
                if group is not None:
                    done.append((*group, digest.hexdigest()))
                group, digest = at, hashlib.sha256(key.encode())
            if done:
                yield _batch(done, batch.schema)
            types = batch.schema
        if group is not None:
            yield _batch([(*group, digest.hexdigest())], types)

    def _batch(done: list[tuple], types: pa.Schema) -> pa.RecordBatch:
        kinds = [*types.types[:-1], pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=[*types.names[:-1], "digest"])

    return rows.repartition(*by).sortWithinPartitions(*by, "_id").mapInArrow(hashed, found)


def train_digests(samples: DataFrame, by: list[str], fold: str, key: str, held: str = "held") -> DataFrame:
    """(by, held, n, digest) of the ids outside every fold, from sums by fold.
    Sets without members are left out."""
    each = samples.groupBy(*by, fold).agg(*sums(key))
    total = each.groupBy(*by).agg(*[F.sum(c).cast("decimal(38,0)").alias(f"t_{c}") for c in SUMS])
    folds = samples.select(F.col(fold).alias(held)).distinct()
    met = total.join(F.broadcast(folds)).join(each.withColumnRenamed(fold, held), [*by, held], "left")  # a few folds
    rest = met.select(*by, held, *[(F.col(f"t_{c}") - F.coalesce(F.col(c), F.lit(0))).cast("decimal(38,0)").alias(c) for c in SUMS]).where("n > 0")
    return rest.select(*by, held, F.col("n").cast("long").alias("n"), named().alias("digest"))


def stale_digests(tasks: DataFrame, samples: DataFrame, label: str, fold: str, key: str) -> DataFrame:
    """(task_id, problem) of tasks (task_id, fold, target_label, train_digest)
    whose digest is not that of the target's samples outside the task's fold."""
    want = train_digests(samples, [label], fold, key, "fold" if fold != "fold" else "_held").withColumnRenamed("_held", "fold")
    met = tasks.join(want.select(F.col(label).alias("target_label"), "fold", "digest"), ["target_label", "fold"], "left")
    problem = F.when(F.col("digest").isNull(), "no training set").when(~F.col("train_digest").eqNullSafe(F.col("digest")), "other training set")
    return met.select("task_id", problem.alias("problem")).where("problem IS NOT NULL")
