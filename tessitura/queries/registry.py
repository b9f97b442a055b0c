"""Registration of queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..plans.score import OUTPUT_GENOME, Score

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_G = OUTPUT_GENOME
#: The score projection as SQL.
BASE = f"""
note AS (
    SELECT l_suppkey AS piece_id, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 120 AS BIGINT) AS tick,
           CAST(l_linenumber % 4 AS INTEGER) AS channel, CAST(36 + l_partkey % 48 AS INTEGER) AS pitch,
           CAST(1 + CAST(floor(l_extendedprice) AS BIGINT) % 127 AS INTEGER) AS velocity,
           CAST(floor(l_quantity) AS BIGINT) * 10 - 10 AS duration_ticks
    FROM lineitem
), piece AS (
    SELECT s_suppkey AS piece_id, r_name AS composer, CAST(n_nationkey AS INTEGER) AS group_id, CAST(n_nationkey // 5 AS INTEGER) AS fold,
           480 AS ticks_per_beat, 1 AS smf_format
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), tempo AS (
    SELECT piece_id, CAST(0 AS BIGINT) AS tick, CAST(400000 + 10000 * group_id AS INTEGER) AS tempo FROM piece
), meter AS (
    SELECT piece_id, CAST(0 AS BIGINT) AS tick, 4 AS numerator, 4 AS denominator FROM piece
    UNION ALL SELECT piece_id, 115200, 3, 4 FROM piece WHERE piece_id % 3 = 1
    UNION ALL SELECT piece_id, 172800, 6, 8 FROM piece WHERE piece_id % 3 = 2
), output_note AS (
    SELECT piece_id, greatest(CAST(round_even(tick * {_G["density"]}, 0) AS BIGINT), 0) AS tick, channel, CAST(pitch + {int(_G["transpose"])} AS INTEGER) AS pitch,
           CAST(least(greatest(velocity + {int(_G["velocity"])}, 0), 127) AS INTEGER) AS velocity,
           greatest(CAST(round_even(duration_ticks * {_G["duration"]}, 0) AS BIGINT), 0) AS duration_ticks
    FROM note WHERE pitch + {int(_G["transpose"])} BETWEEN 0 AND 127
), skyline AS (
    SELECT piece_id, tick, max(pitch) AS pitch FROM note GROUP BY piece_id, tick
), ends AS (
    SELECT piece_id, max(tick + duration_ticks) AS end_tick FROM note GROUP BY piece_id
), ev AS (
    SELECT user_id AS piece_id, event_id, ts, CAST(36 + CAST(floor(value * 100) AS BIGINT) % 48 AS INTEGER) AS pitch, CAST(props->>'k' AS BIGINT) * 10 AS dur FROM events
)"""


def query(sql: str | None = None, rounds: str = ""):
    """Register a function of a :class:`Score` under its name; ``rounds`` names
    the doubles that are rounded to 6 places on both sides."""
    rounded = rounds.split()

    def register(build: Callable[[Score], DataFrame]) -> Callable[[Score], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(Score(spark, sf_dir))
            return df.withColumns({c: r6(F.col(c)) for c in rounded}) if rounded else df

        QUERIES[build.__name__] = run
        if sql is not None:
            replace = f" REPLACE ({', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in rounded)})" if rounded else ""
            ORACLE_SQL[build.__name__] = f"WITH {BASE} SELECT *{replace} FROM ({sql}) AS q"
        return build

    return register
