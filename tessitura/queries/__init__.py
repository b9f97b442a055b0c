"""Every registered query, with the SQL that must give the same rows."""

from __future__ import annotations

from . import audits, content, features, files, melody, meter, models, nested, notes, openset, records, rolls, segments, selection, statistics, streams, tasks, text  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
