"""Cutting the plans of walks, which would otherwise hold every earlier step more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder, where the session has one; else the plan as it is (fine for the
    few steps of a default walk)."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df
