"""The base build (B1-B7, C1, C2) on a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickscore.functions.constants import WINDOW_DAYS
from clickscore.operators import base as B
from clickscore.sources import fixtures as FX


def stream_events(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """The fixture event table read as a file stream (same mapping as the batch source)."""
    folder = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    raw = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .option("pathGlobFilter", "events*.parquet").parquet(folder))
    return FX.events_mapping(raw)


def stream_base_events(events: DataFrame, survey: DataFrame, dim: DataFrame, app: str, role: str,
                       window_days: int = WINDOW_DAYS, only_window: bool = True) -> DataFrame:
    """Stream-static base build: each micro-batch of events is joined map-side
    with the (static, size-checked, broadcast) respondents and dimension.
    Stateless, so no watermark is needed; append output mode.  No literal time
    bounds: they would be frozen when the query starts."""
    return B.base_events(B.respondents(survey, app, role), events, dim, window_days, only_window=only_window,
                         scan_bounds=False)
