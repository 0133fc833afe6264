"""Chains of text filters, traced stage by stage, and the savings they make."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from tarnwork.functions import classify, jsonyaml, text as tx
from tarnwork.operators import code, logs
from tarnwork.sources.readers import written


class TokenFilter(Protocol):
    """A named expression from text to text."""

    name: str

    def __call__(self, text: Column) -> Column: ...


@dataclass(frozen=True)
class ColumnFilter:
    name: str
    apply: Callable[[Column], Column]

    def __call__(self, text: Column) -> Column:
        return self.apply(text)


IDENTITY = ColumnFilter("identity", lambda c: c)
CODE = ColumnFilter("code_cleaner", code.clean_code)
LOG = ColumnFilter("log_cleaner", logs.clean_log)
DATA = ColumnFilter("data_converter", lambda c: jsonyaml.json_to_yaml(c))
BY_KIND = {"code": CODE, "log": LOG, "json": DATA}


@dataclass
class Pipeline:
    """Filters applied one after another."""

    stages: list[TokenFilter] = field(default_factory=list)

    def register(self, stage: TokenFilter) -> Pipeline:
        self.stages.append(stage)
        return self

    def __len__(self) -> int:
        return len(self.stages)

    @property
    def is_empty(self) -> bool:
        return not self.stages

    @property
    def stage_names(self) -> list[str]:
        return [s.name for s in self.stages]

    def __repr__(self) -> str:
        return f"Pipeline({', '.join(self.stage_names)})"

    def execute(self, df: DataFrame, column: str = "body", output: str = "output") -> DataFrame:
        return self.execute_traced(df, column, output).drop("input_bytes", "output_bytes", "bytes_saved", "stages")

    def execute_traced(self, df: DataFrame, column: str = "body", output: str = "output") -> DataFrame:
        """Adds the output, bytes before and after, bytes saved, and an array with the bytes of each stage.

        A stage is a projection of its own, so its expression stands in the plan once.
        """
        # Names that no column of the payloads has.
        names = [f"stage {i} of {len(df.columns)}: {'_'.join(df.columns)}" for i in range(len(self.stages))]
        before, out = F.col(column), df
        reports = []
        for name, stage in zip(names, self.stages):
            out = out.withColumn(name, stage(before))
            reports.append(F.struct(F.lit(stage.name).alias("stage"), tx.byte_length(before).alias("input_bytes"), tx.byte_length(F.col(f"`{name}`")).alias("output_bytes")))
            before = F.col(f"`{name}`")
        sizes = tx.byte_length(F.col(column)), tx.byte_length(before)
        empty = F.array().cast("array<struct<stage: string, input_bytes: bigint, output_bytes: bigint>>")
        out = out.withColumns({output: before, "input_bytes": sizes[0], "output_bytes": sizes[1], "bytes_saved": sizes[0] - sizes[1], "stages": F.array(*reports) if reports else empty})
        return out.drop(*names)


    def execute_timed(self, df: DataFrame, column: str = "body", output: str = "output") -> tuple[DataFrame, DataFrame]:
        """The output, and per stage: place, stage, input_bytes, output_bytes, elapsed_us.

        Stages of one projection have no time of their own, so each is written before the next; for
        measuring, not for production.
        """
        spark, rows, reports = df.sparkSession, df.withColumn(output, F.col(column)), []
        for place, stage in enumerate(self.stages):
            before, began = rows.agg(F.coalesce(F.sum(tx.byte_length(F.col(output))), F.lit(0))).first()[0], time.perf_counter()
            rows = written(rows.withColumn(output, stage(F.col(output))), "stage")
            elapsed = int(1e6 * (time.perf_counter() - began))
            after = rows.agg(F.coalesce(F.sum(tx.byte_length(F.col(output))), F.lit(0))).first()[0]
            reports.append((place, stage.name, before, after, elapsed))
        return rows, spark.createDataFrame(reports, "place int, stage string, input_bytes long, output_bytes long, elapsed_us long")


def baseline_pipeline() -> Pipeline:
    """Code, log and data filter in sequence."""
    return Pipeline().register(CODE).register(LOG).register(DATA)


def routed(payloads: DataFrame, column: str = "body", kind: str | None = None) -> DataFrame:
    """Adds kind (classified, unless a column declares it) and output, each payload through its own filter only.

    JSON payloads are a branch of their own, so that no other text crosses to Python.
    """
    rows = payloads.withColumn("kind", F.col(kind) if kind else classify.payload_kind(F.col(column)))
    body = F.col(column)
    text = rows.where(F.coalesce(F.col("kind") != "json", F.lit(True)))
    text = text.withColumn("output", F.when(F.col("kind") == "log", logs.clean_log(body)).otherwise(code.clean_code(body)))
    return text.unionByName(rows.where("kind = 'json'").withColumn("output", jsonyaml.json_to_yaml(body)))


def savings(df: DataFrame, before: Column, after: Column, *keys: str) -> DataFrame:
    """Sums before, after and saved, and the saving in percent (0 of nothing), by the keys and in total."""
    out = df.select(*keys, before.cast("long").alias("_b"), after.cast("long").alias("_a"))
    out = (out.rollup(*keys) if keys else out.groupBy()).agg(F.count("*").alias("n"), F.coalesce(F.sum("_b"), F.lit(0)).alias("before"), F.coalesce(F.sum("_a"), F.lit(0)).alias("after"))
    saved = F.greatest(F.col("before") - F.col("after"), F.lit(0))
    return out.withColumn("saved", saved).withColumn("saved_pct", F.when(F.col("before") == 0, 0.0).otherwise(100.0 * saved / F.col("before")))


#: Fixed value: the split pattern of the cl100k vocabulary.
CL100K = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"""


def token_counter(ranks_path: str, pattern: str = CL100K):
    """A counter of byte-pair tokens by a file of ranks (base64 token and rank a line) and its split pattern.

    Names of special tokens count as ordinary text. The file has to be readable on every executor.
    """

    @pandas_udf(LongType())
    def count_tokens(texts: pd.Series) -> pd.Series:
        encoding = _encoding(ranks_path, pattern)
        return texts.map(lambda t: len(encoding.encode_ordinary(t)) if t is not None else None)

    return count_tokens


_encodings: dict = {}


def _encoding(path: str, pattern: str):
    if (path, pattern) not in _encodings:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def telemetry(cleaned: DataFrame, counter, column: str = "body", output: str = "output", context: DataFrame | None = None, elapsed_ms: float | None = None) -> DataFrame:
    """metric and value: tokens before and after, saved, percent saved, and if given the context's tokens and the time."""
    # Written first: Spark can't plan a Python function of the output of another one below a union.
    cleaned = written(cleaned.select(column, output), "cleaned")
    tokens = savings(cleaned, counter(F.col(column)), counter(F.col(output)))
    parts = [("initial_tokens", F.col("before")), ("final_tokens", F.col("after")), ("tokens_saved", F.col("saved")), ("saved_pct", F.col("saved_pct"))]
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in parts))
    out = tokens.select(F.inline(rows))
    if context is not None:
        out = out.union(context.agg(F.sum(counter(F.col("context"))).cast("double").alias("value")).select(F.lit("context_tokens"), "value"))
    if elapsed_ms is not None:
        out = out.union(out.sparkSession.createDataFrame([("elapsed_ms", float(elapsed_ms))], "metric string, value double"))
    return out
