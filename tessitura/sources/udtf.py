"""``midi_events``: a table function over the bytes of a file, for LATERAL joins.

    SELECT f.path, e.* FROM files f, LATERAL midi_events(f.content) e

A file that cannot be decoded is one row with ``error`` and nothing else; null
bytes give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import smf

EVENTS = "track int, seq int, tick long, kind string, channel int, data1 int, data2 int, tempo int, numerator int, denominator int, text string, error string"
_NOTHING = (None,) * 11


class MidiEvents:
    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None:
            return
        try:
            found = smf.decode(bytes(content))[2]
        except smf.SmfError as e:
            yield *_NOTHING, str(e)
            return
        for track, event in found:
            yield track, *event, None


def register(spark: SparkSession) -> None:
    spark.udtf.register("midi_events", F.udtf(MidiEvents, returnType=EVENTS))
