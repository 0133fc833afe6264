"""Reciprocal rank fusion that merges neighbouring hits and floats certain ones.

Hits are as the rankers give them, with an optional query_id. Hits that share an id, and hits of one
file whose windows are near, form one candidate. Its score sums weight / (K + rank) over the best hit
of each ranker; a candidate with a confidence above the override gets weight * (1 + confidence)
instead, and goes first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnwork.operators.ranking import ranked
from tarnwork.sources.readers import written


#: Windows that a call works on, about.
LOT = 20_000


@dataclass(frozen=True)
class Fusion:
    k: float = 60.0
    window: int = 15
    override: float = 0.95
    #: What an override adds to the score, besides its confidence.
    floats: float = 1000.0
    #: A span so much longer than the window stays by itself.
    slack: int = 5


def ranked_list(items: DataFrame, name: str, weight: float, place: str = "place") -> DataFrame:
    """Items as the hits of a ranker: a rank of 0 or null becomes the item's ``place`` (from 1) in the list, an empty ranker the list's name."""
    rank = F.when(F.col("rank") > 0, F.col("rank")).otherwise(F.col(place)).cast("int")
    named = F.coalesce(F.nullif("ranker", F.lit("")), F.lit(name)) if "ranker" in items.columns else F.lit(name)
    return items.withColumns({"rank": rank, "ranker": named, "weight": F.lit(float(weight))}).drop(place)


def normalised(hits: DataFrame) -> DataFrame:
    """Hits with line numbers and ranks of at least 1, and confidences in 0 .. 1."""
    start = F.greatest("line_start", F.lit(1))
    out = hits.withColumn("line_start", start).withColumn("line_end", F.greatest("line_end", "line_start"))
    out = out.withColumn("rank", F.greatest("rank", F.lit(1))).withColumn("confidence", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)))
    return out if "query_id" in hits.columns else out.withColumn("query_id", F.lit(0))


def near_windows(windows: DataFrame, options: Fusion) -> DataFrame:
    """query_id, file_path, line_start, line_end of short windows, and first_start and first_end of the least window they are joined to.

    A file's windows are cut into runs where a gap is too wide to be bridged, and whole runs, of any
    files, are dealt into lots. Windows are distinct and short, so each line of a run has at most
    window + slack of them; only a run itself must fit in a call.
    """
    by_start = Window.partitionBy("query_id", "file_path").orderBy("line_start", "line_end")
    so_far = by_start.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("line_end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    cut = windows.withColumn("gap", F.when(F.col("line_start") - reach - 1 <= options.window, 0).otherwise(1)).withColumn("at", F.row_number().over(by_start))
    cut = written(cut.withColumn("run", F.max(F.when(F.col("gap") == 1, F.col("at"))).over(so_far)).drop("gap", "at"), "runs")
    lots = cut.count() // LOT + 1
    cut = cut.withColumn("lot", F.pmod(F.xxhash64("query_id", "file_path", F.floor(F.col("run") / LOT)), F.lit(lots)))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = ["query_id", "file_path", "run"]
        pdf = pdf.sort_values([*keys, "line_start", "line_end"], ignore_index=True)
        lo, hi = pdf["line_start"].to_numpy().astype(np.int64), pdf["line_end"].to_numpy().astype(np.int64)
        span, root = hi - lo + 1, list(range(len(pdf)))
        # On one axis, the runs stand too far apart to meet.
        new = ~pdf[keys].eq(pdf[keys].shift()).all(axis=1).to_numpy()
        ends = np.maximum.reduceat(hi, np.flatnonzero(new))
        shift = (np.cumsum(ends + options.window + 2) - ends)[np.cumsum(new) - 1]
        lo, hi = lo + shift, hi + shift

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        ends = np.searchsorted(lo, hi + options.window + 1, "right")
        for i in np.flatnonzero(ends > np.arange(1, len(pdf) + 1)):
            near = np.arange(i + 1, ends[i])
            merged = np.maximum(hi[near], hi[i]) - lo[i] + 1
            for j in near[merged <= options.window + np.maximum(span[near], span[i])]:
                a, b = sorted((top(i), top(int(j))))
                root[b] = a
        first = [top(i) for i in range(len(pdf))]
        return pdf.assign(first_start=(lo - shift)[first], first_end=(hi - shift)[first])[["query_id", "file_path", "line_start", "line_end", "first_start", "first_end"]]

    kinds = {c: windows.schema[c].dataType.simpleString() for c in ("query_id", "file_path", "line_start", "line_end")}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + f", first_start {kinds['line_start']}, first_end {kinds['line_end']}"
    return cut.groupBy("lot").applyInPandas(join, schema)


def _shared(clusters: DataFrame) -> DataFrame | None:
    """query_id, cluster and root of the clusters (query_id, cluster, id) that share ids, directly or through others; None if none do.

    The least cluster is passed on along ids until nothing changes, a written table per round.
    """
    spread = clusters.groupBy("query_id", "id").agg(F.count("*").alias("n")).where("n > 1")
    edges = written(clusters.join(spread.drop("n"), ["query_id", "id"], "left_semi"), "shared-ids")
    if edges.limit(1).count() == 0:
        return None
    roots = edges.select("query_id", "cluster", F.col("cluster").alias("root")).distinct()
    while True:
        least = edges.join(roots, ["query_id", "cluster"]).groupBy("query_id", "id").agg(F.min("root").alias("root"))
        after = written(edges.join(least, ["query_id", "id"]).groupBy("query_id", "cluster").agg(F.min("root").alias("root")), "shared-roots")
        moved = after.join(roots.withColumnRenamed("root", "old"), ["query_id", "cluster"]).where("root <> old")
        if moved.limit(1).count() == 0:
            return after
        roots = after


def clustered(hits: DataFrame, options: Fusion = Fusion()) -> DataFrame:
    """Normalised hits with the cluster they are in: the least window (file_path, line_start, line_end, one) of it.

    Same ids are one cluster wherever they stand, in other files as well. Else both spans must be short
    and the merged span not longer than the window plus the longer of them.
    """
    hits = written(normalised(hits), "hits")
    short = F.col("line_end") - F.col("line_start") + 1 <= options.window + options.slack
    near = near_windows(hits.where(short).select("query_id", "file_path", "line_start", "line_end").distinct(), options)
    hits = hits.join(near, ["query_id", "file_path", "line_start", "line_end"], "left")
    # A long window is a cluster for each id; without an id, for each hit.
    known = F.coalesce("id", F.lit("")) != ""
    one = F.when(short, "").when(known, F.col("id")).otherwise(F.concat_ws("\0", F.lit(""), "ranker", F.col("rank").cast("string")))
    cluster = F.struct("file_path", F.coalesce("first_start", "line_start").alias("line_start"), F.coalesce("first_end", "line_end").alias("line_end"), one.alias("one"))
    hits = hits.withColumn("cluster", cluster).drop("first_start", "first_end")
    roots = _shared(hits.where(known).select("query_id", "cluster", "id").distinct())
    if roots is None:
        return hits
    return hits.join(roots, ["query_id", "cluster"], "left").withColumn("cluster", F.coalesce("root", "cluster")).drop("root")


def _content(rows: DataFrame, sources: DataFrame | None, loose: Column) -> DataFrame:
    """Content from the files (file_path, source) where known, else from the hits."""
    if sources is None:
        return rows.withColumn("content", loose)
    rows = rows.join(sources.select("file_path", F.col("source").alias("whole")), "file_path", "left")
    lines = F.transform(F.split(F.regexp_replace("whole", r"\n\z", ""), "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    cut = F.slice(lines, F.col("line_start").cast("int"), (F.col("line_end") - F.col("line_start") + 1).cast("int"))
    known = F.col("whole").isNotNull() & (F.col("whole") != "") & (F.col("line_start") <= F.size(lines))
    return rows.withColumn("content", F.when(known, F.array_join(cut, "\n")).otherwise(loose)).drop("whole")


def blend(hits: DataFrame, sources: DataFrame | None = None, options: Fusion = Fusion(), top_k: int | None = None) -> DataFrame:
    """Candidates in order: query_id, position, id, file_path, line_start, line_end, content, score, confidence, override_floated, members, contributions.

    Content comes from the files (file_path, source) where known, else from the hits' distinct contents by
    line. A candidate over several files stands in that of its first hit, by weight, ranker and rank.
    Hits without query_id are one query, whose candidates are ranked by a range sort.
    """
    rows = clustered(hits, options)
    key = ["query_id", "cluster"]
    first = F.struct((-F.col("weight")).alias("w"), "ranker", "rank", "file_path")
    whole = rows.groupBy(key).agg(
        F.min(first)["file_path"].alias("file_path"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_set("id")).alias("members"),
        F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct("line_start", "content"))), lambda x: x["content"])).alias("parts"),
    )
    best = rows.groupBy(*key, "ranker").agg(F.min(F.struct("rank", "weight")).alias("b"), F.max("confidence").alias("c"))
    joined = best.join(whole.select(*key, (F.col("confidence") > options.override).alias("override_floated")), key)
    partial = F.when(F.col("override_floated"), F.col("b.weight") * (1 + F.col("c"))).otherwise(F.col("b.weight") / (max(options.k, 0.0) + F.col("b.rank")))
    part = F.struct("ranker", F.col("b.weight").alias("weight"), F.col("b.rank").alias("rank"), F.col("c").alias("confidence"), partial.alias("partial"))
    sums = joined.groupBy(*key, "override_floated").agg(F.array_sort(F.collect_list(part)).alias("contributions"))
    out = whole.join(sums, key).drop("cluster")
    # Summed in the order of the rankers' names, so that reruns agree to the last digit.
    score = F.aggregate("contributions", F.lit(0.0), lambda s, x: s + x["partial"])
    out = out.withColumn("score", F.when(F.col("override_floated"), score + options.floats + F.col("confidence")).otherwise(score))
    window = F.concat("file_path", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))
    out = out.withColumn("id", F.when(F.size("members") == 1, F.col("members")[0]).otherwise(window))
    order = [F.desc("override_floated"), F.desc(F.when(F.col("override_floated"), F.col("confidence"))), F.desc("score"), "line_start", "file_path", "id"]
    if "query_id" in hits.columns:
        out = out.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
        out = out if top_k is None else out.where(F.col("position") <= top_k)
    else:
        out = ranked(out, *order, limit=top_k).withColumnRenamed("rank", "position")
    out = _content(out, sources, F.array_join("parts", "\n"))
    return out.select("query_id", "position", "id", "file_path", "line_start", "line_end", "content", "score", "confidence", "override_floated", "members", "contributions")


def context(blended: DataFrame) -> DataFrame:
    """query_id and the candidates' windows as one text, in order."""
    line = F.format_string("# %s %s:%d-%d\n%s\n", "file_path", "id", F.col("line_start").cast("long"), F.col("line_end").cast("long"), "content")
    parts = blended.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("text")))).alias("parts"))
    return parts.select("query_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("context"))
