"""Queries on open-set recognition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import openset
from .models import CENTROID, predictions
from .registry import query

SCORED = f"""SELECT piece_id, group_id, true_label, predicted_label, round(1 / (1 + distance), 4) AS score, group_id % 5 <> 2 AS is_known FROM ({CENTROID}) p"""
CURVE = f"""WITH c AS (SELECT score, count_if(is_known) AS pos, count_if(NOT is_known) AS neg FROM ({SCORED}) s GROUP BY score)
    SELECT score, sum(pos) OVER w / sum(pos) OVER () AS tpr, sum(neg) OVER w / sum(neg) OVER () AS fpr, sum(pos) OVER w / (sum(pos) OVER w + sum(neg) OVER w) AS precision FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"""


def _scored(s):
    return predictions(s).select("piece_id", "group_id", "true_label", "predicted_label", F.round(1 / (1 + F.col("distance")), 4).alias("score"), (F.pmod("group_id", F.lit(5)) != 2).alias("is_known"))


@query(CURVE, rounds="score tpr fpr precision")
def open_curve(s):
    return openset.curve(_scored(s)).select("score", "tpr", "fpr", "precision")


@query(
    f"""WITH r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM ({SCORED}) s)
    SELECT (sum(CASE WHEN is_known THEN r END) - count_if(is_known) * (count_if(is_known) + 1) / 2) / (count_if(is_known) * count_if(NOT is_known)) AS auroc FROM r""",
    rounds="auroc",
)
def open_auroc(s):
    return openset.auroc(_scored(s))


@query(f"SELECT sum(precision * (tpr - p)) AS auprc FROM (SELECT *, coalesce(lag(tpr) OVER (ORDER BY score DESC), 0.0) AS p FROM ({CURVE}) c) z", rounds="auprc")
def open_auprc(s):
    return openset.average_precision(_scored(s))


@query(f"SELECT min(fpr) AS fpr FROM ({CURVE}) c WHERE tpr >= 0.9", rounds="fpr")
def fpr_at_tpr(s):
    return openset.fpr_at_tpr(_scored(s), 0.9)


BEST = f"""SELECT score AS threshold, tpr AS known_recall, 1 - fpr AS unknown_recall, (tpr + 1 - fpr) / 2 AS balanced_accuracy FROM ({CURVE}) c WHERE tpr >= 0.8
    ORDER BY round((tpr + 1 - fpr) / 2, 12) DESC, round(1 - fpr, 12) DESC, score DESC LIMIT 1"""


@query(BEST, rounds="threshold known_recall unknown_recall balanced_accuracy")
def open_threshold(s):
    return openset.choose_threshold(_scored(s), 0.8)


@query(
    f"""SELECT CASE WHEN is_known THEN true_label ELSE 'unknown' END AS true_label, CASE WHEN score >= 0.9 THEN predicted_label ELSE 'unknown' END AS open_prediction, count(*) AS n FROM ({SCORED}) s GROUP BY ALL"""
)
def open_confusion(s):
    return openset.open_confusion(openset.open_predictions(_scored(s), 0.9))


@query(
    f"""SELECT avg(CASE WHEN is_known THEN CAST(score >= 0.9 AS INTEGER) END) AS known_recall, avg(CASE WHEN NOT is_known THEN CAST(score < 0.9 AS INTEGER) END) AS unknown_recall, avg(CAST(score >= 0.9 AS INTEGER)) AS coverage,
    avg(CASE WHEN is_known AND score >= 0.9 THEN CAST(true_label = predicted_label AS INTEGER) END) AS accepted_accuracy FROM ({SCORED}) s""",
    rounds="known_recall unknown_recall coverage accepted_accuracy",
)
def open_metrics(s):
    return openset.open_metrics(openset.open_predictions(_scored(s), 0.9))


@query("SELECT piece_id, CAST(CAST(('0x' || substr(sha256('42|' || piece_id), 1, 16)) AS UBIGINT) % 5 AS BIGINT) AS fold FROM piece")
def unknown_hash_fold(s):
    return s.piece.select("piece_id", openset.unknown_fold(42, F.col("piece_id"), 5).alias("fold"))


@query(
    """WITH p AS (SELECT vec_id % 50 AS k, label, avg(embedding[1]::DOUBLE) AS probability FROM embeddings GROUP BY ALL)
    SELECT k, label, probability, row_number() OVER (PARTITION BY k ORDER BY probability DESC, label) = 1 AS is_best FROM p""",
    rounds="probability",
)
def unknown_mean_argmax(s):
    e = s.table("embeddings").select(F.pmod("vec_id", F.lit(50)).alias("k"), "label", F.col("embedding")[0].cast("double").alias("probability"))
    return openset.mean_scores(e, "k")
