"""Retrieval over indexed source files: three rankers, PageRank from the vector hits, and fusion."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tarnwork.operators import fusion, graph, rankers, scopes, vectors
from tarnwork.sources.readers import written

# Least similarity of a hit that PageRank starts from, and its settings; how many of its nodes are looked at, and their greatest confidence.
FLOOR, DAMPING, ITERATIONS, TOLERANCE = 0.05, 0.85, 50, 1e-12
PER_RESULT, LEAST_LOOKED_AT, MOST_CONFIDENT = 3, 8, 0.94


@dataclass
class Outcome:
    query: str
    vector: DataFrame
    symbol: DataFrame
    keyword: DataFrame
    pagerank: DataFrame
    blended: DataFrame
    n_nodes: int
    n_edges: int

    def context(self) -> DataFrame:
        return fusion.context(self.blended)


class RetrievalEngine:
    """Files are indexed, then queried. Indexing more makes the next query rebuild chunks, idf and graph.

    ``vector_limit`` cuts the vector list, so that PageRank's promotions can add to it; without, every chunk is in it already.
    """

    def __init__(self, vector_limit: int | None = None, options: fusion.Fusion = fusion.Fusion()):
        self.files: list[DataFrame] = []
        self.vector_limit, self.options = vector_limit, options
        self.chunks = self.nodes = self.edges = self.idf = self.counts = self.lengths = None

    def index(self, files: DataFrame) -> RetrievalEngine:
        """Adds files (file_path, source)."""
        self.files.append(files.select("file_path", "source"))
        self.chunks = None
        return self

    @property
    def sources(self) -> DataFrame:
        """One text per path: that indexed last."""
        numbered = [f.withColumn("_batch", F.lit(i)) for i, f in enumerate(self.files)]
        latest = reduce(DataFrame.unionByName, numbered).groupBy("file_path").agg(F.max_by("source", "_batch").alias("source"))
        return latest

    def finalize(self) -> RetrievalEngine:
        parsed = reduce(DataFrame.unionByName, [scopes.parse_files(f).withColumn("batch", F.lit(i)) for i, f in enumerate(self.files)])
        # The order as a text that sorts alike: a running number would need all rows in one task.
        seq = F.concat_ws(":", F.lpad(F.col("batch").cast("string"), 6, "0"), "file_path", F.lpad(F.col("byte_start").cast("string"), 12, "0"), F.lpad(F.col("position").cast("string"), 8, "0"))
        self.chunks = written(parsed.withColumn("seq", seq), "chunks")
        self.idf = written(vectors.fit_idf(self.chunks, "seq", "source"), "idf")
        self.counts = written(rankers.embedded(self.chunks), "vectors")
        self.lengths = written(vectors.norms(vectors.weights(self.counts, "seq", self.idf), "seq"), "norms")
        imports = scopes.parse_imports(self.sources)
        nodes, edges = graph.scope_graph(self.chunks, imports)
        self.nodes, self.edges = written(nodes, "nodes"), written(edges, "edges")
        return self

    def query(self, query: str, top_k: int) -> Outcome:
        if self.chunks is None:
            self.finalize()
        candidates = self.chunks.withColumn("id", F.col("chunk_id"))
        vector = written(rankers.vector_hits(candidates, self.counts, self.lengths, self.idf, query, self.vector_limit), "vector")
        symbol, keyword = rankers.symbol_hits(candidates, query), rankers.keyword_hits(candidates, query)
        focus = graph.focus_from_hits(vector.select(F.col("id").alias("key"), F.col("confidence").alias("similarity")), FLOOR)
        pagerank = written(graph.personalized_pagerank(self.nodes, self.edges, focus, DAMPING, ITERATIONS, TOLERANCE), "pagerank")
        looked_at = pagerank.orderBy(F.desc("rank"), "key").limit(max(PER_RESULT * top_k, LEAST_LOOKED_AT))
        n = vector.count()
        fresh = looked_at.join(vector.select(F.col("id").alias("key")), "key", "left_anti").join(candidates.dropDuplicates(["id"]).withColumn("key", F.col("id")).drop("rank"), "key")
        rank = n + F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rank"), "key"))
        fresh = fresh.select(F.lit("vector").alias("ranker"), F.lit(rankers.VECTOR[1]).alias("weight"), rank.alias("rank"), F.least("rank", F.lit(MOST_CONFIDENT)).alias("confidence"), "id", "file_path", "line_start", "line_end", F.col("source").alias("content"))
        hits = vector.unionByName(fresh).unionByName(symbol).unionByName(keyword)
        blended = fusion.blend(hits, self.sources, self.options, top_k)
        return Outcome(query, vector, symbol, keyword, pagerank, blended, self.nodes.count(), self.edges.count())
