"""Run fitted row-local repairs on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import DEFAULT, Config
from ..plans.cleaning import CleaningPlan


def clean_stream(stream: DataFrame, plan: CleaningPlan, config: Config = DEFAULT) -> DataFrame:
    """Apply a plan fitted on a batch to a streaming table.

    Fills, caps, formats and case repairs carry fitted constants and are plain
    projections, so they need no state.  Duplicate removal and flags compare
    rows and are left out.
    """
    return plan.row_local().apply(stream, config)
