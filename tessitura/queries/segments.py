"""Queries on segments: grid, stitching, datasets, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, meter, segments
from ..plans.score import TICKS_PER_BEAT as TPB
from .meter import BARS
from .registry import query

CELLS = f"{BARS}, cells AS (SELECT piece_id, bar_index * 16 + k AS step, bar_start + CAST(round_even((bar_end - bar_start) * k / 16, 0) AS BIGINT) AS cell_start, bar_start + CAST(round_even((bar_end - bar_start) * (k + 1) / 16, 0) AS BIGINT) AS cell_end FROM bars, (SELECT unnest(range(16)) AS k))"
FRAMES = f"""{CELLS}, spans AS (SELECT n.piece_id, n.pitch, a.step AS first, b.step AS last FROM (SELECT *, tick + duration_ticks - 1 AS last FROM note WHERE pitch BETWEEN 24 AND 107 AND duration_ticks > 0) n
    ASOF JOIN cells a ON n.piece_id = a.piece_id AND n.tick >= a.cell_start ASOF JOIN cells b ON n.piece_id = b.piece_id AND n.last >= b.cell_start),
    frames AS (SELECT piece_id, pitch, step, bool_or(first = step) AS onset FROM (SELECT piece_id, pitch, first, unnest(range(first, last + 1)) AS step FROM spans) GROUP BY ALL)"""


def _bars(s):
    return meter.bars(s.meter, intervals.end_ticks(s.note), TPB)


@query(f"WITH {CELLS} SELECT * FROM cells")
def grid_cells(s):
    return segments.grid(_bars(s)).select("piece_id", F.col("step").cast("long").alias("step"), "cell_start", "cell_end")


@query(f"WITH {FRAMES} SELECT * FROM frames")
def frame_cells(s):
    return segments.frame_cells(s.note, segments.grid(_bars(s))).select("piece_id", "pitch", F.col("step").cast("long").alias("step"), "onset")


@query(
    f"""WITH {FRAMES}, i AS (SELECT *, step - row_number() OVER (PARTITION BY piece_id, pitch ORDER BY step) AS run FROM frames), v AS (SELECT *, sum(CAST(onset AS INTEGER)) OVER (PARTITION BY piece_id, pitch, run ORDER BY step ROWS UNBOUNDED PRECEDING) AS nth FROM i),
    s AS (SELECT piece_id, pitch, min(step) AS a, max(step) AS b FROM v WHERE nth > 0 GROUP BY piece_id, pitch, run, nth),
    t AS (SELECT s.piece_id, s.pitch, x.cell_start AS tick, coalesce(y.cell_start, e.end_tick) - x.cell_start AS d FROM s JOIN cells x ON x.piece_id = s.piece_id AND x.step = s.a LEFT JOIN cells y ON y.piece_id = s.piece_id AND y.step = s.b + 1 JOIN ends e ON e.piece_id = s.piece_id)
    SELECT piece_id, tick, v[1] AS channel, pitch, v[2] AS velocity, d AS duration_ticks FROM (SELECT t.piece_id, t.pitch, t.tick, t.d, arg_min((n.channel, n.velocity), (abs(n.tick - t.tick), n.tick, n.channel, n.velocity)) AS v FROM t JOIN note n ON n.piece_id = t.piece_id AND n.pitch = t.pitch WHERE d > 0 GROUP BY ALL) z"""
)
def segment_stitch(s):
    """Frames and onsets of whole pieces, decoded over segment borders."""
    frames = segments.frame_steps(s.note, _bars(s)).withColumn("o", F.col("onset").cast("int"))
    found = segments.decoded(frames, _bars(s), s.note, intervals.end_ticks(s.note))
    return found.select("piece_id", "tick", "channel", "pitch", "velocity", "duration_ticks")


@query(
    f"""WITH {BARS}, n AS (SELECT *, tick + duration_ticks AS e, tick + duration_ticks - 1 AS last FROM note WHERE pitch BETWEEN 24 AND 107 AND duration_ticks > 0),
    m AS (SELECT n.*, a.bar_end - a.bar_start AS la, b.bar_start AS bs, b.bar_end - b.bar_start AS lb FROM n ASOF JOIN bars a ON n.piece_id = a.piece_id AND n.tick >= a.bar_start ASOF JOIN bars b ON n.piece_id = b.piece_id AND n.last >= b.bar_start)
    SELECT piece_id, tick, pitch, duration_ticks, coalesce(list_min([x FOR x IN l IF x >= e]), list_max(l)) - e AS end_error, la / 16 AS start_step_width, lb / 16 AS end_step_width
    FROM (SELECT *, [bs + CAST(round_even(lb * k / 16, 0) AS BIGINT) FOR k IN range(17)] AS l FROM m) z""",
    rounds="start_step_width end_step_width",
)
def quantisation_end_errors(s):
    return segments.end_errors(s.note, _bars(s))


#: Five folds; of the four others the next is the validation of each inner fold.
SPLIT = "SELECT piece_id, CASE WHEN fold = 2 THEN 'test' WHEN fold = (2 + 1 + 1) % 5 THEN 'validation' ELSE 'train' END AS split FROM piece"


def _splits(s):
    outer = F.explode(F.sequence(F.lit(0), F.lit(4)))
    inner = F.explode(F.sequence(F.lit(0), F.lit(2)))
    at = s.piece.select("piece_id", F.col("fold").alias("own")).withColumn("fold", outer)
    test = at.where("own = fold").select(F.lit(0).alias("repeat"), "fold", F.lit(None).cast("int").alias("inner_fold"), F.lit("test").alias("role"), "piece_id")
    within = at.where("own <> fold").withColumn("inner_fold", inner)
    role = F.when(F.col("own") == F.pmod(F.col("fold") + F.col("inner_fold") + 1, F.lit(5)), "validation").otherwise("train")
    return test.unionByName(within.select(F.lit(0).alias("repeat"), "fold", "inner_fold", role.alias("role"), "piece_id"))


def _members(s):
    return segments.split_roles(_splits(s), 0, 2, 1)


@query(SPLIT)
def protocol_split(s):
    return _members(s)


@query(f"SELECT piece_id, split FROM ({SPLIT}) m WHERE piece_id % 6 <> 0")
def eligible_pieces(s):
    return segments.eligible(_members(s), s.piece.where("piece_id % 6 = 0"))


@query(f"SELECT 'validation' AS scope, piece_id FROM ({SPLIT}) m WHERE split = 'train' UNION ALL SELECT 'test', piece_id FROM ({SPLIT}) m WHERE split <> 'test'")
def fit_scope(s):
    m = _members(s)
    one = lambda scope: segments.fit_scope(m, scope).select(F.lit(scope).alias("scope"), "piece_id")
    return one("validation").unionByName(one("test"))


def _index(s):
    members = _members(s).join(s.piece, "piece_id").select("piece_id", "group_id", F.col("composer").alias("label"), "split")
    cells = segments.frame_cells(s.note, segments.grid(_bars(s))).select("piece_id", F.floor(F.col("step") / 64).alias("segment"))
    return members, cells


@query(f"WITH {FRAMES} SELECT DISTINCT piece_id, group_id, composer AS label, split, step // 64 AS segment FROM frames JOIN piece USING (piece_id) JOIN ({SPLIT}) m USING (piece_id) WHERE composer <> 'ASIA'")
def segment_index(s):
    return segments.segment_index(*_index(s), ["AFRICA", "AMERICA", "EUROPE", "MIDDLE EAST"])[0]


@query(
    """SELECT CAST(piece_id AS VARCHAR) AS key, 'repeated piece' AS problem FROM piece WHERE piece_id % 9 = 0 UNION ALL SELECT CAST(piece_id AS VARCHAR), 'unknown label' FROM (SELECT piece_id FROM piece WHERE composer = 'ASIA' UNION ALL SELECT piece_id FROM piece WHERE composer = 'ASIA' AND piece_id % 9 = 0) x
    UNION ALL SELECT DISTINCT CAST(group_id AS VARCHAR), 'group crosses splits' FROM piece WHERE piece_id % 9 = 0"""
)
def segment_index_problems(s):
    members, cells = _index(s)
    broken = members.unionByName(members.where("piece_id % 9 = 0").withColumn("split", F.lit("elsewhere")))
    return segments.segment_index(broken, cells, ["AFRICA", "AMERICA", "EUROPE", "MIDDLE EAST"])[1]


@query(f"WITH {FRAMES} SELECT piece_id, max(bar_index) // 4 + 1 AS segments, coalesce(any_value(n), 0) AS nonempty FROM bars LEFT JOIN (SELECT piece_id, count(DISTINCT step // 64) AS n FROM frames GROUP BY piece_id) f USING (piece_id) GROUP BY piece_id")
def segment_counts(s):
    return segments.segment_counts(_bars(s), _index(s)[1])


@query("SELECT composer, CAST(row_number() OVER (ORDER BY composer) - 1 AS INTEGER) AS index, [CAST(i = row_number() OVER (ORDER BY composer) - 1 AS INTEGER) FOR i IN range(5)]::VARCHAR AS one_hot FROM (SELECT DISTINCT composer FROM piece)")
def label_index(s):
    from ..functions.scalar import one_hot

    found = segments.label_index(s.piece, "composer")
    return found.withColumn("one_hot", F.concat(F.lit("["), F.array_join(one_hot(F.col("index"), 5).cast("array<string>"), ", "), F.lit("]")))
