"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier in numpy is fitted from confirmed toxic texts and unlabelled ones. With the class
prior p, the risk is p * R(toxic as 1) + max(0, R(unlabelled as 0) - p * R(toxic as 0)): the second
part estimates the risk on clean text; where an over-fitted model would push it below zero, it counts
as zero and only the first part is descended. The bias is then moved so that the share p of the
unlabelled sample scores 0.5 or more, unless that would take texts with hardly any evidence. Features are the words of a text (present or not) whose shares of the two samples differ beyond chance. Labels are read only for training rows: those for which crc32 of
the doc_id as text isn't 0 modulo 5. Neither labels nor lang, source or doc_id enter a score.

The fit reads a bounded sample: at most ``POSITIVES`` toxic and ``UNLABELLED`` other training
documents, least hash of doc_id first, and of near copies among them one; the prior is the toxic share of all labelled training rows.
Scores cover every whole text. Null and empty texts are scored by the bias alone. A null doc_id
counts as an empty text in the fold rule. Very long texts count like others, each word once; ties in the
sample's order go by doc_id. Without any toxic training row every score is the prior's, 0
if no row is labelled at all. Repeated rows are scored alike; other columns don't matter.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tarnwork.llm import common

POSITIVES = 8_000
UNLABELLED = 16_000
#: Most words in the vocabulary (those most typical of toxic texts), and the sampled documents that a word must stand in.
VOCABULARY = 2_000
LEAST_DOCUMENTS = 3
#: Standard deviations by which a word's share of toxic documents must exceed its share of unlabelled ones.
LEAST_Z = 6.0
#: Times by which the toxic share must exceed the other: common words that only tell languages or lengths apart stay out.
LEAST_RATIO = 3.0
FOLDS = 5
EPOCHS = 100
BATCHES = 20

KEYS = 4
#: Labelled rows among the unlabelled sample from which its own prior is taken.
LEAST_KNOWN = 100
_MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263)
_word = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_word.findall((text or "").lower()))


def _least_hashes(text: str) -> list[int]:
    """The least hashes of the text's five-word runs: near copies share most of them, other texts none."""
    own = text.split()
    runs = np.array([zlib.crc32(" ".join(own[i : i + 5]).encode()) for i in range(max(1, len(own) - 4))], np.uint64)
    return [int(((runs * np.uint64(m)) % np.uint64(4294967291)).min()) for m in _MULTIPLIERS]


def remainder(doc_id, folds: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


class Classifier:
    """Weights by word, and a bias: the score is the logistic function of their sum."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        get = self.weights.get
        total = self.bias + sum(sorted(w for x in words(text) if (w := get(x)) is not None))
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


class _Rows:
    """Documents as rows of word numbers, for products with a weight vector."""

    def __init__(self, lists: list[np.ndarray], scale: np.ndarray):
        self.lists, self.scale = lists, scale

    def batch(self, which: np.ndarray):
        own = [self.lists[i] for i in which]
        columns = np.concatenate(own) if own else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
        return columns, rows, self.scale[columns], len(own)


def nonnegative_fit(toxic: list[np.ndarray], rest: list[np.ndarray], scale: np.ndarray, prior: float, seed: int = 0):
    """Weights and bias that minimise the non-negative risk with the logistic loss, by Adam steps over batches."""
    rng = np.random.default_rng(seed)
    p_rows, u_rows = _Rows(toxic, scale), _Rows(rest, scale)
    w, b = np.zeros(len(scale)), float(np.log(prior / (1 - prior)))
    m, v, t, rate, decay = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1), 0, 0.05, 1e-5

    def outputs(part):
        columns, rows, values, n = part
        return np.bincount(rows, w[columns] * values, n) + b

    def gradient(part, d):
        columns, rows, values, _ = part
        return np.append(np.bincount(columns, d[rows] * values, len(scale)), d.sum())

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for _ in range(EPOCHS):
        p_order, u_order = rng.permutation(len(toxic)), rng.permutation(len(rest))
        for i in range(BATCHES):
            p_part, u_part = p_rows.batch(p_order[i::BATCHES]), u_rows.batch(u_order[i::BATCHES])
            if not p_part[3] or not u_part[3]:
                continue
            zp, zu = outputs(p_part), outputs(u_part)
            # Logistic loss: as 1 log(1 + e^-z), as 0 log(1 + e^z).
            clean_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            clean = gradient(u_part, sigmoid(zu) / u_part[3]) - prior * gradient(p_part, sigmoid(zp) / p_part[3])
            g = prior * gradient(p_part, (sigmoid(zp) - 1) / p_part[3])
            if clean_risk > 0:
                g += clean
            g[:-1] += decay * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
    return w, b


def prior_shift(scores: np.ndarray, none: float, prior: float) -> float:
    """What to add to the bias so that, if fewer are, the share ``prior`` of the unlabelled sample is called toxic.

    ``scores`` are its logits and ``none`` that of a text without any word of the vocabulary; such a text
    is never called toxic, nor is one that is nearer to it than to the scores called toxic so far.
    """
    ranked = np.sort(scores)[::-1]
    due = int(round(prior * len(scores)))
    if not due or ranked[due - 1] >= 0 or ranked[0] <= 0:
        return 0.0
    cut = max(ranked[due - 1], none / 2)
    return float(-cut) + 1e-6 if cut < 0 else 0.0


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fits on training rows of ``docs`` (doc_id, text), with ``labels`` (doc_id, toxic)."""
    spark = docs.sparkSession
    train = remainder(F.col("doc_id"), FOLDS) != 0
    known = labels.select("doc_id", "toxic").where(train & F.col("toxic").isNotNull())
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not n_toxic:
        return Classifier({}, -35.0)
    prior = min(max(n_toxic / n, 1e-4), 1 - 1e-4)
    order = F.xxhash64("doc_id", F.lit(8))

    def least(df, most, toxic):
        ids = df.select("doc_id").distinct().orderBy(order, "doc_id").limit(most)
        return ids.withColumn("toxic", F.lit(toxic))

    # At most POSITIVES + UNLABELLED rows of two numbers: safe to broadcast. Kinds 2 and 3: of the unlabelled, what is known.
    drawn = least(docs.where(train), UNLABELLED, 0)
    also = known.join(F.broadcast(drawn.select("doc_id")), "doc_id").select("doc_id", F.when(F.col("toxic") == 1, 2).otherwise(3).alias("toxic"))
    chosen = least(known.where("toxic = 1"), POSITIVES, 1).union(drawn).union(also)
    chosen = chosen.groupBy("doc_id").agg(F.sort_array(F.collect_set("toxic")).alias("kinds"))

    def listed(batches):
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            columns = [batch.column(0), pa.array([sorted(words(t)) for t in texts], pa.list_(pa.string()))]
            keys = [_least_hashes(t) for t in texts]
            columns += [pa.array([k[i] for k in keys], pa.int64()) for i in range(KEYS)]
            yield pa.RecordBatch.from_arrays(columns, ["kinds", "words", *(f"k{i}" for i in range(KEYS))])

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("kinds", "text")
    sample = sample.mapInArrow(listed, "kinds array<int>, words array<string>" + "".join(f", k{i} bigint" for i in range(KEYS)))
    for i in range(KEYS):  # copies would make their own words look toxic: one of them stands for all
        first = F.row_number().over(Window.partitionBy("kinds", f"k{i}").orderBy("words"))
        sample = sample.withColumn("first", first).where("first = 1")
    sample = common.written(sample.select("kinds", "words"), "toxicity-sample")
    sizes = sample.agg(*(F.sum(F.array_contains("kinds", k).cast("long")) for k in (1, 0, 2, 3))).first()
    if not all(sizes[:2]):
        return Classifier({}, -35.0)
    if sizes[2] + sizes[3] >= LEAST_KNOWN:  # without copies, the share isn't that of all rows
        prior = min(max(sizes[2] / (sizes[2] + sizes[3]), 1e-4), 1 - 1e-4)
    in_p, in_u = (F.sum(F.array_contains("kinds", k).cast("long")) for k in (1, 0))
    counted = sample.select("kinds", F.explode("words").alias("word")).groupBy("word").agg(in_p.alias("p"), in_u.alias("u"), F.count("*").alias("n"))
    share = (F.col("p") + F.col("u")) / float(sizes[0] + sizes[1])
    z = (F.col("p") / sizes[0] - F.col("u") / sizes[1]) / F.sqrt(share * (1 - share + 1e-9) * (1 / sizes[0] + 1 / sizes[1]))
    counted = counted.where(F.col("n") >= LEAST_DOCUMENTS).withColumn("z", z).where(F.col("z") >= LEAST_Z)
    of_p, of_u = F.col("p") / sizes[0], F.col("u") / sizes[1]
    counted = counted.where(of_p >= LEAST_RATIO * of_u)
    vocabulary = counted.orderBy(F.desc("z"), "word").limit(VOCABULARY).collect()
    number = {r.word: i for i, r in enumerate(vocabulary)}
    toxic, rest = [], []
    known_words = F.array_intersect("words", F.array(*map(F.lit, number))) if number else F.array().cast("array<string>")
    for row in sample.select("kinds", known_words.alias("words")).toLocalIterator():
        own = np.array([i for w in row.words if (i := number.get(w)) is not None], np.int64)
        for kind, into in ((1, toxic), (0, rest)):
            if kind in row.kinds:
                into.append(own)
    if not toxic or not rest:
        return Classifier({}, -35.0)
    by_words = lambda x: (len(x), x.tobytes())  # noqa: E731  the same order whatever the tasks were
    toxic.sort(key=by_words)
    rest.sort(key=by_words)
    w, b = nonnegative_fit(toxic, rest, np.ones(len(vocabulary)), prior)
    b += prior_shift(np.array([b + w[x].sum() for x in rest]), b, prior)
    return Classifier({r.word: float(x) for r, x in zip(vocabulary, w) if abs(x) > 1e-4}, float(b))


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id and score of every row. The model is at most ``VOCABULARY`` words and is sent with the tasks."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            values = [model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, score double")


def without_toxic(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows whose text scores below 0.5, with every column as it was."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([model.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    held = remainder(F.col("doc_id"), FOLDS) == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
