"""Fixed schemas. Readers pass them on and never infer types."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

SCHEMA_VERSION = "1.0.0"


_KINDS = {"long": LongType(), "int": IntegerType(), "string": StringType(), "double": DoubleType()}


def _of(columns: str) -> StructType:
    """From ``name type`` pairs; needs no session."""
    return StructType([StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(","))])


NOTE = _of("piece_id long, tick long, channel int, pitch int, velocity int, duration_ticks long")
META = _of("piece_id long, tick long, kind string, tempo int, numerator int, denominator int")
PIECE = _of("piece_id long, composer string, group_id int, fold int, ticks_per_beat int, smf_format int")
RAW_EVENT = _of(
    "path string, track int, seq int, tick long, kind string, channel int, data1 int, data2 int, tempo int, "
    "numerator int, denominator int, text string"
)
PREDICTION = _of(
    "analysis string, variant string, model string, repeat int, fold int, piece_id long, group_id int, true_label string, predicted_label string"
)
SPLIT = _of("repeat int, fold int, inner_fold int, role string, piece_id long")
TASK = _of("phase string, repeat int, fold int, source_id long, source_label string, target_label string, task_id string, signature string")
MANIFEST = _of("path string, sha256 string, duration_s double, tracks int, source string")
