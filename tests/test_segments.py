"""Cells from bars, and stitching without a product of bars in a join."""

import random
import re

from tessitura.operators import segments

NOTES = "piece_id long, tick long, channel int, pitch int, velocity int, duration_ticks long"
BARS = "piece_id long, bar_index int, bar_start long, bar_end long"


def pieces(spark, seed=4):
    rng = random.Random(seed)
    bars, notes, ends = [], [], []
    for piece in range(6):
        at = 0
        for i in range(rng.randint(1, 9)):
            length = rng.choice((1, 3, 7, 15, 16, 17, 24, 40, 96, 1920))
            bars.append((piece, i, at, at + length))
            at += length
        ends.append((piece, at))
        for _ in range(40):
            tick = rng.randrange(at)
            notes.append((piece, tick, rng.randrange(3), rng.choice((20, 30, 31, 32)), rng.randrange(1, 9), rng.randint(0, at - tick)))
    return spark.createDataFrame(notes, NOTES), spark.createDataFrame(bars, BARS), spark.createDataFrame(ends, "piece_id long, end_tick long"), notes


def test_cells_that_follow_from_bars_are_those_of_the_grid(spark):
    notes, bars, _, _ = pieces(spark)
    want = {tuple(r) for r in segments.frame_cells(notes, segments.grid(bars)).collect()}
    assert want == {tuple(r) for r in segments.frame_steps(notes, bars).collect()}


def test_stitching_looks_up_bars_and_joins_no_cells(spark):
    notes, bars, ends, plain = pieces(spark)
    frames = segments.frame_steps(notes, bars)
    step = ("piece_id", "pitch", "step")
    found = segments.stitched(frames.where("onset").select(*step), frames.select(*step), bars, notes, ends)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins and not any(re.search(r"\b(step|cell_start|bar_index|a|b)#", x) for x in joins), joins

    starts = {(r.piece_id, r.step): (r.cell_start, r.cell_end) for r in segments.grid(bars).collect()}
    cells = {(r.piece_id, r.pitch, r.step): r.onset for r in frames.collect()}
    want = [x for x in plain if not 24 <= x[3] < 108]
    for (piece, pitch, at), onset in cells.items():
        if onset:
            last = at
            while cells.get((piece, pitch, last + 1)) is False:
                last += 1
            tick, until = starts[piece, at][0], starts[piece, last][1]
            near = min((abs(x[1] - tick), x[1], x[2], x[4]) for x in plain if x[0] == piece and x[3] == pitch)
            if until > tick:
                want.append((piece, tick, near[2], pitch, near[3], until - tick))
    assert sorted(want) == sorted(tuple(r) for r in found.collect())
