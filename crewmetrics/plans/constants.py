"""Driver-side rule tables as literals of the plan."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(value, ddl: str) -> Column:
    """A nested literal; Catalyst folds it once, so no join or broadcast is planned for it."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


def bind(value: Column, body) -> Column:
    """``let v = value in body(v)``: ``value`` is evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]
