"""Task lists as shared sets with changes of their own."""

from tessitura.operators import records
from tessitura.queries import QUERIES


def test_shared_sets_find_what_whole_lists_find(spark):
    samples = spark.createDataFrame([(k, "AB"[k % 2], k % 5, k % 3) for k in range(1, 25)], "sample_id long, label string, group_id int, fold int")
    rows = {r.sample_id: r for r in samples.collect()}
    base = {(f, x): [k for k, r in rows.items() if r.fold != f and r.label == x] for f in range(3) for x in "AB"}
    changes = [[], [(3, 1)], [(4, 1), (4, -1)], [("first", -1)], [("first", 1)], [("source", 1)], [(999, 1)], [("first", -1), (999, 1)]]
    tasks, edits, lists = [], [], []
    for k, r in rows.items():
        for n, change in enumerate(changes):
            target, name = "AB"[(k + n // 3) % 2], f"{k}-{n}"
            ids = list(base[r.fold, target])
            for what, times in change:
                sample = {"first": ids[0] if ids else 7, "source": k}.get(what, what)
                edits.append((name, sample, times))
                ids = ids + [sample] if times > 0 else [x for j, x in enumerate(ids) if j != ids.index(sample)]
            tasks.append((name, r.fold, k, r.label if k % 4 else "other", target, f"{r.fold}|{target}"))
            lists.append((name, ids))
    of = spark.createDataFrame(tasks, "task_id string, fold int, source_id long, source_label string, target_label string, set_id string")
    sets = spark.createDataFrame([(f"{f}|{x}", k) for (f, x), ids in base.items() for k in ids], "set_id string, sample_id long")
    whole = of.join(spark.createDataFrame(lists, "task_id string, target_train_ids array<long>"), "task_id")
    want = sorted(map(tuple, records.membership_problems(whole, samples).collect()))
    got = sorted(map(tuple, records.shared_membership_problems(of, sets, spark.createDataFrame(edits, "task_id string, sample_id long, n int"), samples).collect()))
    assert got == want
    assert {p for _, p in got} >= {"target training set", "source group in training", "source label"}


def test_no_task_carries_a_list_of_ids(spark, sf_dir, tmp_path):
    for name in ("nation", "region", "supplier"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    plan = QUERIES["task_membership"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
