"""Joining group-level results back to rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F


def join_groups(df: DataFrame, groups: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on grouping keys as ``groupBy`` understands them: NULL is a key like any other, so no
    row is lost. Still an equi-join for Spark."""
    renamed = groups.withColumnsRenamed({k: f"_g_{k}" for k in on})
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in on])
    return df.join(renamed, match, how).drop(*[f"_g_{k}" for k in on])
