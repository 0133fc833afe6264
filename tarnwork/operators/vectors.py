"""Sparse TF-IDF vectors: a row per text with its distinct features and their counts, and cosine similarity.

Counts are made once for each text, where it lies; only distinct features are ever shuffled, and a
query's similarity needs no more than the rows of its own few features.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnwork.sources.readers import spread, written

#: Features up to which a table of idf or of a query's weights is sent to every task, about 100 bytes each; beyond, it is joined by a shuffle.
MOST_SENT = 200_000
#: Features after which a worker hands its rows on.
BATCH = 100_000

_word = re.compile("[A-Za-z0-9_]{2,}")
_control = re.compile("[\x00-\x1f\x7f-\x9f]")
_lower = {c: c + 32 for c in range(65, 91)}


def features(text: str) -> Counter[str]:
    """Counts of a text's features: tokens, neighbouring token pairs and character triples share one space."""
    low = text.lower() if text.isascii() else text.translate(_lower)
    words = _word.findall(low)
    chars = _control.sub("", low)
    return Counter(chain(words, map(" ".join, zip(words, words[1:])), map("".join, zip(chars, chars[1:], chars[2:]))))


def counted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, and counts: the text's distinct features in order as an array of (feature, tf). Null texts have none."""
    kind = docs.schema[key].dataType.simpleString()

    def made(keys, ends, names, numbers):
        pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int32())], ["feature", "tf"])
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], [key, "counts"])

    def run(batches):
        for batch in batches:
            first, ends, names, numbers = 0, [0], [], []
            for i in range(batch.num_rows):
                own = sorted(features(batch.column(1)[i].as_py() or "").items())
                names.extend(f for f, _ in own)
                numbers.extend(n for _, n in own)
                ends.append(len(names))
                if len(names) >= BATCH or i == batch.num_rows - 1:
                    yield made(batch.column(0).slice(first, i + 1 - first), ends, names, numbers)
                    first, ends, names, numbers = i + 1, [0], [], []

    return spread(docs.select(key, text)).mapInArrow(run, f"{key} {kind}, counts array<struct<feature: string, tf: int>>")


def idf_of(counts: DataFrame) -> DataFrame:
    """feature and idf = ln((n + 1) / (df + 1)) + 1 over rows of counts."""
    n = max(counts.count(), 1)
    df = counts.select(F.explode("counts.feature").alias("feature")).groupBy("feature").agg(F.count("*").alias("df"))
    return df.select("feature", (F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def fit_idf(docs: DataFrame, key: str, text: str) -> DataFrame:
    return idf_of(written(counted(docs, key, text), "counts"))


def weights(counts: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """key, feature and weight; features that weren't fitted count once."""
    sent = F.broadcast(idf) if idf.limit(MOST_SENT + 1).count() <= MOST_SENT else idf
    rows = counts.select(key, F.inline("counts")).join(sent, "feature", "left")
    return rows.select(key, "feature", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("weight"))


def norms(weighted: DataFrame, key: str) -> DataFrame:
    """key and norm of rows of weights; texts without features have none."""
    return weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def similarities(query: str, counts: DataFrame, lengths: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """key and similarity (cosine, clamped to 0 .. 1) of the rows of counts, with their norms, that share a feature with the query.

    A query's features are as many as its characters at most, so they can be sent to every task; its
    weights need the idf of those features alone.
    """
    own = sorted(features(query).items())
    asked = counts.sparkSession.createDataFrame(own, "feature string, qtf int")
    few = len(own) <= MOST_SENT
    known = idf.join(F.broadcast(asked) if few else asked, "feature")
    # Features that weren't fitted have an idf of 1.
    known = written(asked.join(known.select("feature", "idf"), "feature", "left").select("feature", (F.col("qtf") * F.coalesce("idf", F.lit(1.0))).alias("qw"), F.coalesce("idf", F.lit(1.0)).alias("idf")), "query")
    length = known.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw")))).first()[0]
    rows = counts.select(key, F.inline("counts")).join(F.broadcast(known) if few else known, "feature")
    dot = rows.groupBy(key).agg(F.sum(F.col("tf") * F.col("idf") * F.col("qw")).alias("dot"))
    sim = F.col("dot") / (F.col("norm") * F.lit(length))
    return dot.join(lengths, key).select(key, F.least(F.greatest(sim, F.lit(0.0)), F.lit(1.0)).alias("similarity"))
