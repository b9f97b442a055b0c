"""Queries on nested folds, forests grown together, nested validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts, evaluation, forests, histograms, nested, scenario
from ..plans.checkpoints import checkpoint
from .features import PC
from .models import _vectors
from .registry import query

OUTER, INNER, REPEATS = 5, 3, 5


def _folds(s):
    counts = s.piece.groupBy("group_id", F.col("composer").alias("label")).agg(F.count("*").alias("n"))
    return nested.nested_folds(counts, OUTER, INNER, REPEATS)


@query(
    f"""SELECT r AS repeat, o AS outer_fold, i AS inner_fold, 0::BIGINT AS crossings, 0::BIGINT AS missing, (SELECT count(*) FROM piece) AS samples
    FROM range({REPEATS}) t(r), range({OUTER}) u(o), range(-1, {INNER}) v(i)"""
)
def nested_fold_contract(s):
    """Of every fit: groups on both sides, samples not tested once by its fold's
    cover (outer folds over a repeat, inner folds over a training part), and
    samples of the outer fold's two parts."""
    folds = checkpoint(_folds(s))
    cells = nested.cells(folds, INNER)
    cell = ["repeat", "outer_fold", "inner_fold"]
    crossing = contracts.group_crossings(cells, "group_id", "is_train", cell).groupBy(*cell).agg(F.count("*").alias("crossings"))
    by_group = s.piece.groupBy("group_id").agg(F.count("*").alias("n"))
    tested = cells.where("NOT is_train")
    inner = tested.where("inner_fold >= 0").groupBy("repeat", "outer_fold", "group_id").agg(F.count("*").alias("times"))
    outer = tested.where("inner_fold = -1").groupBy("repeat", "group_id").agg(F.count("*").alias("times"))
    trained = folds.where("inner_fold IS NOT NULL").select("repeat", "outer_fold", "group_id")
    lost_inner = trained.join(inner.where("times = 1"), ["repeat", "outer_fold", "group_id"], "left_anti").groupBy("repeat", "outer_fold").agg(F.count("*").alias("lost"))
    lost_outer = folds.select("repeat", "group_id").distinct().join(outer.where("times = 1"), ["repeat", "group_id"], "left_anti").groupBy("repeat").agg(F.count("*").alias("lost_outer"))
    whole = folds.join(by_group, "group_id").groupBy("repeat", "outer_fold").agg(F.sum("n").alias("samples"))
    every = cells.select(*cell).distinct().join(crossing, cell, "left").join(lost_inner, ["repeat", "outer_fold"], "left").join(lost_outer, "repeat", "left").join(whole, ["repeat", "outer_fold"])
    missing = F.when(F.col("inner_fold") == -1, F.coalesce("lost_outer", F.lit(0))).otherwise(F.coalesce("lost", F.lit(0)))
    return every.select(*[F.col(c).cast("long").alias(c) for c in cell], F.coalesce("crossings", F.lit(0)).cast("long").alias("crossings"), missing.cast("long").alias("missing"), "samples")


TREES, BINS, SEED = 4, 16, 7
_H = "CAST(('0x' || substr(sha256({k}), 1, 16)) AS UBIGINT)"
_U = _H.format(k=f"'{SEED}|' || forest || '|' || tree || '|' || piece_id") + " / 18446744073709551616.0"
_J = _H.format(k=f"'{SEED}|' || forest || '|' || tree || '|1|' || j")
_POISSON = " + ".join(f"(u >= {p!r})::INTEGER" for p in forests.POISSON)
LABELS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _weights(of: str) -> str:
    return " + ".join(f"{of}{k} * w{k}" for k in range(5))


def _impurity(of: str) -> str:
    return "1 - (" + " + ".join(f"power({of}{k} * w{k} / ({_weights(of)}), 2)" for k in range(5)) + ")"


@query(
    f"""WITH v AS MATERIALIZED (SELECT piece_id, fold, composer, idx, value FROM ({PC}) p JOIN piece USING (piece_id)),
    sorted AS (SELECT idx, list_sort(list(value)) AS l FROM v GROUP BY idx),
    edge AS (SELECT DISTINCT idx, l[1 + CAST(floor((len(l) - 1) * k / {BINS}) AS BIGINT)] AS e FROM sorted, range(1, {BINS}) t(k)),
    b AS MATERIALIZED (SELECT v.piece_id, v.fold, v.composer, v.idx, count(e) AS bin FROM v LEFT JOIN edge ON edge.idx = v.idx AND e < v.value GROUP BY ALL),
    forest AS (SELECT DISTINCT 'fold' || fold AS forest, fold FROM piece), tree AS (SELECT forest, fold, t AS tree FROM forest, range({TREES}) x(t)),
    member AS (SELECT DISTINCT forest, tree, b.piece_id, composer FROM tree JOIN b ON b.fold <> tree.fold),
    drawn AS (SELECT forest, tree, piece_id, composer, {_POISSON} AS w FROM (SELECT *, {_U} AS u FROM member)),
    cw AS (SELECT forest, {", ".join(f"coalesce(sum(n) / (count(*) * nullif(max(CASE WHEN composer = '{c}' THEN n END), 0)), 0) AS w{k}" for k, c in enumerate(LABELS))}
           FROM (SELECT forest, composer, count(DISTINCT piece_id) AS n FROM member GROUP BY ALL) GROUP BY forest),
    total AS (SELECT forest, tree, {", ".join(f"coalesce(sum(CASE WHEN composer = '{c}' THEN w END), 0) AS t{k}" for k, c in enumerate(LABELS))} FROM drawn GROUP BY ALL),
    tried AS (SELECT DISTINCT forest, tree, CAST({_J} % 12 AS INTEGER) AS idx FROM tree, range(3) x(j)),
    cell AS (SELECT forest, tree, idx, bin, {", ".join(f"coalesce(sum(CASE WHEN drawn.composer = '{c}' THEN w END), 0) AS c{k}" for k, c in enumerate(LABELS))}
             FROM drawn JOIN tried USING (forest, tree) JOIN b USING (piece_id, idx) WHERE w > 0 GROUP BY ALL),
    cut AS (SELECT forest, tree, idx, bin, {", ".join(f"sum(c{k}) OVER upto AS l{k}" for k in range(5))} FROM cell WINDOW upto AS (PARTITION BY forest, tree, idx ORDER BY bin)),
    sides AS (SELECT cut.*, total.* EXCLUDE (forest, tree), cw.* EXCLUDE (forest), {", ".join(f"t{k} - l{k} AS r{k}" for k in range(5))} FROM cut JOIN total USING (forest, tree) JOIN cw USING (forest)),
    gain AS (SELECT forest, tree, idx AS feature, bin, round({_impurity("t")} - ({_weights("l")}) / ({_weights("t")}) * ({_impurity("l")}) - ({_weights("r")}) / ({_weights("t")}) * ({_impurity("r")}), 12) AS gain
             FROM sides WHERE l0 + l1 + l2 + l3 + l4 >= 1 AND r0 + r1 + r2 + r3 + r4 >= 1)
    SELECT forest, CAST(tree AS INTEGER) AS tree, feature, CAST(bin AS INTEGER) AS bin, gain FROM gain WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY forest, tree ORDER BY gain DESC, feature, bin) = 1""",
    rounds="gain",
)
def forest_root_splits(s):
    """The first cut of every tree of a forest per held-out fold, over the twelve pitch classes."""
    shares = histograms.histogram(s.note, F.pmod("pitch", F.lit(12)), 12).join(s.piece, "piece_id")
    shares = checkpoint(shares.select("piece_id", "fold", "composer", "values"))
    label = F.array_position(F.array(*map(F.lit, LABELS)), F.col("composer")).cast("int") - 1
    ready = checkpoint(shares.select("piece_id", "fold", label.alias("label"), forests.binned(F.col("values"), forests.bin_edges(shares, "values", BINS)).alias("bins")))
    named = s.piece.select(F.concat(F.lit("fold"), F.col("fold").cast("string")).alias("forest"), F.col("fold").alias("held")).distinct()
    members = ready.join(F.broadcast(named), F.lit(True)).select("forest", "piece_id", (F.col("fold") != F.col("held")).alias("is_train"))  # a row a fold
    kinds = named.select("forest", F.lit(3).alias("max_features"), F.lit(1).alias("min_leaf"))
    weights = forests.class_weights(members, ready, "piece_id", len(LABELS))
    rows = forests.start(ready, members, kinds, TREES, SEED, "piece_id")
    return forests.best_splits(rows, weights, len(LABELS), 12, SEED).select("forest", "tree", "feature", "bin", "gain")


@query()
def nested_cv_forest(s):
    """Of 5 repeats of 5 outer folds: the setting that 3 inner folds chose, and its outer score."""
    samples = s.piece.select("piece_id", "group_id", F.col("composer").alias("label"))
    predictions, choices = nested.nested_forest(_vectors(s).select("piece_id", "vector"), samples, _folds(s), [(9, 1), (46, 2)], INNER, trees=5, depth=4)
    scored = evaluation.summary_metrics(predictions, ["repeat", "outer_fold"])
    return choices.join(scored, ["repeat", "outer_fold"])


@query()
def open_scenario(s):
    """Every region in turn unknown to regressions of the others: calibrated threshold, ranking metrics."""
    regions = [r.r_name for r in s.table("region").select("r_name").distinct().sort("r_name").collect()]  # labels, not rows
    samples = s.piece.select("piece_id", F.col("composer").alias("label"), F.pmod("piece_id", F.lit(OUTER)).cast("int").alias("fold"))
    shares = histograms.histogram(s.note, F.pmod("pitch", F.lit(12)), 12).select("piece_id", F.col("values").alias("vector"))
    metrics, _ = scenario.open_scenarios(checkpoint(shares), samples, scenario.rotations(regions), OUTER, [0, 1], target=0.8)
    return metrics
