"""Plan inspection through the public ``explain`` output."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def exchanges(df: DataFrame) -> list[str]:
    """Shuffle exchanges in the physical plan (broadcasts excluded)."""
    txt = plan_text(df, "simple")
    return re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)[^\n]*", txt)


def has_python_udf(df: DataFrame) -> bool:
    txt = plan_text(df, "simple")
    return any(t in txt for t in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas"))
