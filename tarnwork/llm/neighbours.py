"""Approximate nearest neighbours with vantage-point trees.

Distinct rows are dealt by a hash into shards, and every shard gets a tree over its distinct vectors:
an inner node splits its vectors at the median distance from a vantage point. Largest inner product
becomes least Euclidean distance by one more coordinate, sqrt(M - |x|^2) with M the largest squared
length of all, 0 for queries. A subtree is left out when its triangle-inequality bound times ``factor``
is above the distance of the k-th nearest so far. Factor 1 is exact search; a larger one prunes more.

Queries are searched in blocks of bounded size, a pass over the trees for each block: a task keeps the
best of its block over all trees that it reads, and the bests of the tasks meet in a window. Trees
aren't copied or shuffled.

Vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors are
only compared with those of the same number of components. Repeated rows are candidates each, except
for rows with the query's own vec_id; of several query rows with one vec_id the least vector counts.
Rows without vec_id take no part. Fewer candidates than k are all returned. Scores are summed in
double precision over the original vectors. Of equal scores the smaller vec_id is nearer: candidates
are compared by score and least id, and a subtree or vector is left out only if it is worse than the
k-th by more than rounding may hide.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tarnwork.llm import common

K = 20
FACTOR = 4.0
SHARD = 8192
#: Queries of a pass over the trees; they are sent to every task, and so is bounded what a task keeps.
QUERY_BLOCK = 32_768
#: Queries that go down a tree together.
GROUP = 2048
LEAF = 128
EVERY = 20
#: Relative error that products and distances may have.
ROUNDING = 1e-6


class Tree:
    """A vantage-point tree over distinct vectors; ``ids`` and ``times`` are the smallest distinct ids of each and how many rows have them, as many as a search may need."""

    def __init__(self, ids: np.ndarray, times: np.ndarray, vectors: np.ndarray, longest: float, most: int):
        self.vectors, of = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, of.ravel()))
        cuts = np.flatnonzero(np.diff(of.ravel()[order])) + 1
        self.ids = [g[:most] for g in np.split(ids[order], cuts)]
        self.times = [g[:most] for g in np.split(times[order], cuts)]
        self.first = np.array([g[0] for g in self.ids])
        self.longest = longest
        rest = np.sqrt(np.maximum(longest - (self.vectors**2).sum(1), 0.0))
        self.points = np.column_stack([self.vectors, rest])
        self.nodes: list[tuple] = []
        self._build(np.arange(len(self.vectors)), np.random.default_rng(7))

    def _build(self, members: np.ndarray, rng) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(members) <= LEAF:
            self.nodes[at] = (members,)
            return at
        # Of a few random vantage points the one whose distances spread most.
        best = None
        for v in rng.choice(members, 5, replace=False):
            d = np.sqrt(((self.points[members] - self.points[v]) ** 2).sum(1))
            if best is None or d.var() > best[1].var():
                best = v, d
        v, d = best
        order = np.argsort(d, kind="stable")
        half = len(members) // 2
        near, far = order[:half], order[half:]
        # Distances of the two sides: bounds from within and from without.
        bounds = (d[near[0]], d[near[-1]], d[far[0]], d[far[-1]])
        inner = self._build(members[near], rng)
        outer = self._build(members[far], rng)
        self.nodes[at] = (v, bounds, inner, outer)
        return at

    def search(self, queries: np.ndarray, factor: float, best: Best, base: int = 0) -> None:
        """Adds to ``best`` what this tree has for the queries; slots are numbers of its vectors, from ``base``."""
        q = np.column_stack([queries, np.zeros(len(queries))])
        lengths = (queries**2).sum(1)
        scale = np.sqrt(self.longest) + np.sqrt(lengths)
        doubt = ROUNDING * np.sqrt(self.longest * lengths)

        def reach(who: np.ndarray) -> np.ndarray:
            """Distance of the k-th nearest so far, and what rounding may add."""
            worst = best.scores[who, -1]
            d = np.where(np.isinf(worst), np.inf, np.sqrt(np.maximum(self.longest + lengths[who] - 2 * np.where(np.isinf(worst), 0, worst), 0.0)))
            return d + ROUNDING * scale[who]

        def visit(node: int, who: np.ndarray, bound: np.ndarray):
            keep = bound * factor <= reach(who)
            who = who[keep]
            if not len(who):
                return
            entry = self.nodes[node]
            if len(entry) == 1:
                members = entry[0]
                about = queries[who] @ self.vectors[members].T
                row, column = np.nonzero(about >= (best.scores[who, -1] - doubt[who])[:, None])
                if len(row):
                    own, found = who[row], members[column]
                    best.add(own, (queries[own] * self.vectors[found]).sum(1), self.first[found], base + found)
                return
            v, (a, b, c, e), inner, outer = entry
            bound = bound[keep]
            d = np.sqrt(((q[who] - self.points[v]) ** 2).sum(1))
            low_in = np.maximum(bound, np.maximum(a - d, d - b))
            low_out = np.maximum(bound, np.maximum(c - d, d - e))
            first = low_in <= low_out
            visit(inner, who[first], low_in[first])
            visit(outer, who, low_out)
            visit(inner, who[~first], low_in[~first])

        if len(q) and len(self.vectors):
            visit(0, np.arange(len(q)), np.zeros(len(q)))


class Best:
    """The best vectors of each query so far, by score and then least id; ``slots`` says what they are."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.slots = np.full((n, k), -1)

    def part(self, rows: slice) -> Best:
        """A view of some rows."""
        out = Best(0, self.k)
        out.scores, out.ids, out.slots = self.scores[rows], self.ids[rows], self.slots[rows]
        return out

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, slots: np.ndarray) -> None:
        """``who`` is in ascending order."""
        own = np.unique(who)
        row = np.concatenate([np.repeat(own, self.k), who])
        parts = [np.concatenate([x[own].ravel(), y]) for x, y in ((self.scores, scores), (self.ids, ids), (self.slots, slots))]
        order = np.lexsort((parts[1], -parts[0], row))
        place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        order = order[place < self.k]
        for table, part in zip((self.scores, self.ids, self.slots), parts):
            table[own] = part[order].reshape(len(own), self.k)


def usable(vectors: DataFrame) -> DataFrame:
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def index(vectors: DataFrame, k: int = K) -> DataFrame:
    """One row per shard: dim, shard, tree (bytes). Written to the shared folder."""
    # Repeated rows are one row with their number, so that a third of all rows with one id isn't one shard.
    rows = usable(vectors).groupBy("vec_id", "embedding").agg(F.count("*").alias("times"))
    rows = common.written(rows.withColumn("dim", F.size("embedding")), "vectors")
    n, longest = rows.agg(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))).first()
    shards = max(1, -(-n // SHARD))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(pdf["vec_id"].to_numpy(), pdf["times"].to_numpy(), np.stack(pdf["embedding"].to_numpy()), longest, k + 1)
        return pd.DataFrame({"dim": pdf["dim"][:1], "shard": pdf["shard"][:1], "tree": [pickle.dumps(tree)]})

    return common.written(rows.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary"), "vantage-points")


class Searcher:
    """The k nearest of a block of queries (vec_id, embedding of one length) over the trees shown to it, one after another."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.ids, self.queries, self.k, self.factor = ids, queries, k, factor
        self.best = Best(len(queries), k + 1)  # one more: a query's own row may be among them
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.seen = 0

    def show(self, tree: Tree) -> None:
        for at in range(0, len(self.queries), GROUP):
            part = slice(at, at + GROUP)
            tree.search(self.queries[part], self.factor, self.best.part(part), self.seen)
        # Only what is among the best is held on to.
        slots = np.unique(self.best.slots)
        self.found = {s: self.found[s] if s < self.seen else (tree.ids[s - self.seen], tree.times[s - self.seen]) for s in slots.tolist() if s >= 0}
        self.seen += len(tree.ids)

    def rows(self) -> pa.RecordBatch:
        """query_id, vec_id and score; repeats of a vec_id are rows each."""
        out = [], [], []
        for query, slots, scores in zip(self.ids, self.best.slots, self.best.scores):
            own = [(s, *self.found[x]) for x, s in zip(slots.tolist(), scores) if x >= 0]
            near = sorted(((-s, i, n) for s, ids, times in own for i, n in zip(ids.tolist(), times.tolist()) if i != query), key=lambda x: x[:2])[: self.k]
            near = [x[:2] for x in near for _ in range(min(x[2], self.k))][: self.k]
            out[0].extend([query] * len(near))
            out[1].extend(i for _, i in near)
            out[2].extend(-s for s, _ in near)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])


def search(trees: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest candidates of each query (vec_id, embedding)."""
    rows = common.written(usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    blocks = max(1, -(-rows.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    found = None
    for i in range(blocks):
        # A block is QUERY_BLOCK rows, about, whatever the size of the table.
        own = rows.where(block == i).orderBy("vec_id").toPandas()
        by_dim = {}
        for dim, part in own.groupby(own["embedding"].map(len)):
            by_dim[dim] = part["vec_id"].to_numpy(np.int64), np.stack(part["embedding"].to_numpy()).astype(np.float64)
        sent = queries.sparkSession.sparkContext.broadcast(by_dim)

        def run(batches, sent=sent):
            searchers = {}
            for batch in batches:
                for dim, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if dim in sent.value:
                        if dim not in searchers:
                            searchers[dim] = Searcher(*sent.value[dim], k, factor)
                        searchers[dim].show(pickle.loads(blob.as_py()))
            for searcher in searchers.values():
                yield searcher.rows()

        near = common.written(trees.select("dim", "tree").mapInArrow(run, "query_id long, vec_id long, score double"), "nearest")
        sent.destroy()
        found = near if found is None else found.union(near)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(index(vectors), vectors.where(F.col("vec_id") % EVERY == 0))
