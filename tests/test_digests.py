"""Order-free digests against plain hashing of whole sets."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tessitura.operators import digests, selection


def plain(ids):
    ids = [str(i) for i in ids if i is not None]
    limbs = [sum(int(hashlib.sha256(i.encode()).hexdigest()[16 * k : 16 * k + 16], 16) for i in ids) % 2**64 for k in range(4)]
    return hashlib.sha256("|".join(map(str, [len(ids), *limbs])).encode()).hexdigest()


def test_digests_are_those_of_whole_sets_and_subtract(spark):
    rows = [(f"s{i}", "abc"[i % 3], i % 4) for i in range(50)] + [("s1", "b", 0), (None, "a", 1), ("only", "d", 2)]
    df = spark.createDataFrame(rows, "k string, label string, fold int")
    by = defaultdict(list)
    for k, label, fold in rows:
        by[label, fold].append(k)
    for d in (df, df.repartition(6), df.orderBy(F.desc("k"))):
        assert {(r.label, r.fold): r.digest for r in digests.set_digests(d, ["label", "fold"], "k").collect()} == {k: plain(v) for k, v in by.items()}
    got = {(r.label, r.held): (r.n, r.digest) for r in digests.train_digests(df, ["label"], "fold", "k").collect()}
    want = {}
    for label in "abcd":
        for held in range(4):
            ids = [k for k, lab, f in rows if lab == label and f != held and k is not None]
            if ids:
                want[label, held] = (len(ids), plain(ids))
    assert got == want


def test_stale_digests_are_found(spark):
    samples = spark.createDataFrame([(i, "ab"[i % 2], i % 3) for i in range(12)], "k long, label string, fold int")
    good, whole = plain([i for i in range(0, 12, 2) if i % 3 != 1]), plain(range(0, 12, 2))
    tasks = spark.createDataFrame([("right", 1, "a", good), ("leak", 1, "a", whole), ("none", 1, "z", good), ("null", 1, "a", None)], "task_id string, fold int, target_label string, train_digest string")
    got = {tuple(r) for r in digests.stale_digests(tasks, samples, "label", "fold", "k").collect()}
    assert got == {("leak", "other training set"), ("none", "no training set"), ("null", "other training set")}


def test_profiles_carry_the_hash_of_the_whole_sorted_list(spark):
    rows = [(i, "abc"[i % 3], i % 4) for i in range(400)] + [(1000, "d", 2)]
    samples = spark.createDataFrame(rows, "piece_id long, composer string, fold int")
    long = samples.select("piece_id", F.lit(0).alias("idx"), F.lit(0.5).alias("value"))
    want = {}
    for label in "abcd":
        for held in range(4):
            ids = sorted(str(k) for k, lab, f in rows if lab == label and f != held)
            if ids:
                want[held, label] = hashlib.sha256(",".join(ids).encode()).hexdigest()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for d in (samples, samples.repartition(6), samples.orderBy(F.desc("piece_id"))):
            assert {(r.fold, r.composer): r.fingerprint for r in selection.train_profiles(long, d).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
