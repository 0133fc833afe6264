"""The whole flow: filters by kind, an index of the cleaned code, a query, its context, and what it all saves."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from tarnwork.plans import pipeline
from tarnwork.plans.retrieval import RetrievalEngine
from tarnwork.sources.readers import written


def flow(payloads: DataFrame, query: str, counter, top_k: int = 6, declared: str | None = None, timed: bool = False) -> DataFrame:
    """metric and value: tokens before, after, saved, percent, and of the context retrieved; with ``timed`` the milliseconds, too.

    Payloads are name and body, with a kind in the column ``declared`` or else classified. Cleaned code is
    indexed under its name.
    """
    began = time.perf_counter()
    cleaned = written(pipeline.routed(payloads, kind=declared), "payloads")
    files = cleaned.where("kind = 'code'").select(F.col("name").alias("file_path"), F.col("output").alias("source"))
    context = written(RetrievalEngine().index(files).query(query, top_k).context(), "context")
    elapsed = 1000 * (time.perf_counter() - began) if timed else None
    return pipeline.telemetry(cleaned, counter, context=context, elapsed_ms=elapsed)
