"""Incremental activity rollup of a stream of status events (an extension: the batch form is operators.censoring.activity)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stagewise.bridge import Config
from stagewise.operators.censoring import activity, clean_dates


def activity_stream(canon_events: DataFrame, cfg: Config) -> DataFrame:
    """canon_events: a streaming frame with target_id, centre, status_canon, stage_ord and status_date.

    Write it in update or complete mode: state is one row of maxima and a count for each target."""
    return activity(clean_dates(canon_events, cfg))
