"""Exact deduplication over a log-structured merge index of text digests.

Memtables: every input task digests its own documents and flushes them as one run, sorted by digest
(level 0). A run's filter are the first seven bytes of its digests, kept as a narrow column of their
own. An entry is a hit if the filters of all runs hold its seven bytes more than once; every other
entry is alone and goes to level 1 as it is, without being merged or moved. Hits receive byte
verification: a digest whose normalised bytes differ is split by its texts. Compaction then merges the
hits into one entry per digest that keeps the smallest identifier under the order "most code points in
the original text, then smallest doc_id", and the number of rows.

Texts are equal when identical after deleting the six ASCII white-space characters. A null text
counts as empty, so all empty, blank and null texts form one group. A null doc_id orders last.
Repeated rows (same doc_id and text) are separate members; exactly one row of each group stays.
An empty table gives an empty result. Other columns are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarnwork.llm import common

#: Tasks over which the byte comparison of one digest is spread before its parts are combined.
SALTS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACES, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _sent(df: DataFrame) -> DataFrame:
    """A table of digests or their first bytes: sent to every task if it is small by its count, else joined by a shuffle."""
    return F.broadcast(df) if df.limit(common.MOST_SENT + 1).count() <= common.MOST_SENT else df


class MergeIndex:
    """Sorted digest runs in a shared folder. ``add`` flushes a batch as new runs; ``hits`` looks texts up; ``compact`` merges all runs."""

    def __init__(self, spark: SparkSession, path: str | None = None, digest=sha256):
        self.spark, self.digest = spark, digest
        self.path = path or common.new_path(spark, "merge-index")
        self.batches: list[str] = []
        self.schema = None
        self.compacted: str | None = None
        self.filters: DataFrame | None = None

    def entries_of(self, docs: DataFrame) -> DataFrame:
        """doc_id, digest, its first seven bytes as a number, the text's code points, and the SHA-256 where the digest is another one."""
        text = normalised(F.col("text"))
        entries = docs.select("doc_id", self.digest(text).alias("digest"), (F.lit(None).cast("binary") if self.digest is sha256 else sha256(text)).alias("sha"), F.char_length(F.coalesce("text", F.lit(""))).alias("n_cp"))
        return entries.withColumn("filter", F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"))

    def add(self, docs: DataFrame) -> DataFrame:
        """Flushes one sorted run for each input task (the memtables) and returns the runs."""
        entries = self.entries_of(docs).withColumn("batch", F.lit(len(self.batches))).withColumn("uid", F.monotonically_increasing_id())
        self.batches.append(batch := f"{self.path}/level0-{len(self.batches)}")
        self.schema, self.filters = entries.schema, None
        return common.kept(entries.sortWithinPartitions("digest"), batch)

    def level0(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.batches)

    def twice(self) -> DataFrame:
        """The filter values that occur more than once over all runs; only filters are read and moved."""
        if self.filters is None:
            found = self.level0().groupBy("filter").agg(F.count("*").alias("n")).where("n > 1").select("filter")
            self.filters = common.kept(found, f"{self.path}/twice-{len(self.batches)}")
        return self.filters

    def find(self, text: str) -> DataFrame:
        """Entries of one text's digest; the sorted runs skip row groups that can't hold it."""
        ((key, first),) = self.entries_of(self.spark.createDataFrame([(None, text)], "doc_id long, text string")).select("digest", "filter").collect()
        return self.level0().where((F.col("filter") == first) & (F.col("digest") == F.lit(bytes(key))))

    def hits(self, docs: DataFrame) -> DataFrame:
        """doc_id, keep_id and digest of the rows of a batch whose digest is in the index already: by the filters first, then by digest; bytes aren't compared yet."""
        batch = self.entries_of(docs)
        maybe = batch.join(self.level0().select("filter").distinct(), "filter", "left_semi")
        known = self.compact().select("digest", F.col("doc_id").alias("keep_id"))
        return maybe.select("doc_id", "digest").join(known, "digest").select("doc_id", "keep_id", "digest")

    def merged(self, entries: DataFrame) -> DataFrame:
        """One entry for each digest: the identifier that stays, its place, and the number of rows."""
        best = F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("nil"), "doc_id", "batch", "uid")
        out = entries.groupBy("digest").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
        return out.select("digest", "best.doc_id", "best.batch", "best.uid", "group_size")

    def compact(self) -> DataFrame:
        """All runs as one level: entries whose filter value is alone as they are, the others merged by digest."""
        path = f"{self.path}/level1-{len(self.batches)}"
        if self.compacted != path:
            both, twice = self.level0(), _sent(self.twice())
            alone = both.join(twice, "filter", "left_anti").select("digest", "doc_id", "batch", "uid", F.lit(1).cast("long").alias("group_size"))
            common.kept(alone.union(self.merged(both.join(twice, "filter", "left_semi"))).sortWithinPartitions("digest"), path)
            self.compacted = path
        return self.spark.read.parquet(path)


def differing(docs: DataFrame, hits: DataFrame, digest) -> DataFrame:
    """The digests among ``hits`` that stand for more than one text, after comparing all bytes.

    All texts of a digest are the same exactly when the smallest equals the largest. Both are found
    in parts of a digest first, so that a third of all rows in one group isn't one task.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    texts = docs.select(normalised(F.col("text")).cast("binary").alias("bytes"), salt).withColumn("digest", digest(F.col("bytes")))
    of_hits = texts.join(_sent(hits.select("digest")), "digest", "left_semi")
    ends = of_hits.groupBy("digest", "salt").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b"))
    return ends.groupBy("digest").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("digest")


def exact_groups(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    index = MergeIndex(spark, digest=digest)
    entries, twice = index.add(docs), index.twice()
    top = common.written(index.merged(entries.join(_sent(twice), "filter", "left_semi")).where("group_size > 1"), "hits")
    if common.written(differing(docs, top, digest), "differing").limit(1).count():
        # A digest that stands for several texts: rows are told apart by their bytes.
        index = MergeIndex(spark, digest=lambda c: F.concat(digest(c), c.cast("binary")))
        entries = index.add(docs)
        top = common.written(index.merged(entries.join(_sent(index.twice()), "filter", "left_semi")).where("group_size > 1"), "hits")
    wins = top.select("digest", F.col("doc_id").alias("keep_id"), F.col("batch").alias("keep_batch"), F.col("uid").alias("keep_uid"), "group_size")
    # Entries that aren't hits stand for themselves.
    out = entries.join(_sent(wins), "digest", "left")
    alone = F.col("group_size").isNull()
    kept = alone | (F.col("batch") == F.col("keep_batch")) & (F.col("uid") == F.col("keep_uid"))
    sha = F.lower(F.hex(F.coalesce("sha", "digest")))
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), sha.alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text an earlier-ranked row has; every column stays."""
    numbered = common.numbered(docs)
    doc_id = F.col("row.doc_id")
    order = numbered.select(F.struct(doc_id.isNull().alias("nil"), doc_id.alias("id"), "number").alias("doc_id"), F.col("row.text").alias("text"))
    gone = exact_groups(order).where("NOT kept").select(F.col("doc_id.number").alias("number"))
    return numbered.join(_sent(common.written(gone, "copies")), "number", "left_anti").select("row.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) AS k,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""
