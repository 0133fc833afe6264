"""Near copies of five-word similarity, by several fingerprints per text, verified.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is at least
``SIMILARITY``. Of every text's shingles ``BANDS`` fingerprints are taken, each a hash of ``ROWS``
smallest values under hashes of their own, so texts of similarity s share a given one with
probability s ** ROWS: at 0.8 all of them are missed by 2 pairs in a thousand. Each fingerprint is
looked up as a whole (multi-index hashing of radius zero), in levels:

- Of the texts that share a fingerprint, each is compared with two of them, picked by a hash. That links
  large groups of near copies without comparing them pair by pair.
- A group is settled if all its texts are in one component by then. In every other one, whatever its
  size, each text is compared with all those of other components. A group of more than ``BLOCK`` texts or
  ``BLOCK_CHARS`` code points is dealt into blocks of about that size, and each two blocks that can hold
  different components meet in a group of their own. The blocks of the group's largest component meet only
  the others, so work grows with the texts outside that component times those of the group.

So all near copies that share a fingerprint are linked. In the first step, pairs whose least hashes agree in
fewer than ``AGREE`` of 48 places are passed over, which loses none of them: unless others link them, the
second step compares them by all their shingles. Every link is verified.

The links of ``simhash`` stay as they are; the verified ones are added, and components are taken of both.
Null, empty and blank texts have no fingerprints and are linked by those of ``simhash`` alone; repeated
rows and equal texts are linked; a very long text is hashed in blocks.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tarnwork.llm import common, simhash
from tarnwork.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
#: Shingles of a text that are hashed at once.
BLOCK_SHINGLES = 1 << 12
#: Texts of a group, and their code points, that are compared in one piece; larger groups are dealt into blocks of them.
BLOCK, BLOCK_CHARS = 256, 1 << 24
#: Places of the ``BANDS * ROWS`` least hashes in which two texts must agree to be compared before groups are.
AGREE = 28
#: Distinct shingles that are counted at once when texts are compared in blocks.
COLUMNS = 1 << 13

_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def sketch(text: str | None) -> tuple[list[int], list[int]]:
    """The fingerprints of a text as signed 64-bit integers, and a byte of each least hash; none if it has no words."""
    least, empty = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64), True
    for hashes in simhash.hashes_of(text or "", SHINGLE, BLOCK_SHINGLES):
        values = hashes[None, :] * _FACTORS[:, None] + _SHIFTS[:, None]
        np.minimum(least, values.min(1), out=least)
        empty = False
    if empty:
        return [], []
    bands = least.reshape(BANDS, ROWS)
    keys = [int(np.int64(np.uint64(xxhash.xxh64_intdigest(b.tobytes(), i)))) for i, b in enumerate(bands)]
    return keys, (least >> np.uint64(20)).astype(np.int8).tolist()


@functools.lru_cache(16)
def _set(text: str) -> frozenset[str]:
    return frozenset(simhash.shingles(text, SHINGLE))


def similarity(a: str, b: str) -> float:
    one, two = _set(a), _set(b)
    both = len(one & two)
    return both / (len(one) + len(two) - both) if both else 0.0


def prints(rows: DataFrame) -> DataFrame:
    """number, fp (of ``simhash``), chars, and keys and marks (of ``sketch``) of every row."""

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(1):
                text = t.as_py()
                out.append((simhash.fingerprint(text), len(text or ""), *sketch(text)))
            types = pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int8())
            fps, chars, keys, marks = (pa.array([x[i] for x in out], kind) for i, kind in enumerate(types))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, chars, keys, marks], ["number", "fp", "chars", "keys", "marks"])

    return rows.select("number", "text").mapInArrow(run, "number bigint, fp bigint, chars bigint, keys array<bigint>, marks array<tinyint>")


def _pair(one: str, two: str):
    """a < b and their fps u and v, of two structs of number and fp."""
    first, second = (F.when(F.col(f"{one}.number") < F.col(f"{two}.number"), F.col(x)).otherwise(F.col(y)) for x, y in ((one, two), (two, one)))
    return first["number"].alias("a"), second["number"].alias("b"), first["fp"].alias("u"), second["fp"].alias("v")


def candidates(members: DataFrame) -> DataFrame:
    """Of the members (key, number, fp) of each key, pairs of every one with two, where they aren't of one ``fp``."""
    own = F.struct(F.xxhash64("key", "number").alias("h"), "number", "fp")
    buckets = members.groupBy("key").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo.number <> hi.number")
    met = members.join(buckets, "key").select(F.struct("number", "fp").alias("m"), F.explode(F.array("lo", "hi")).alias("c"))
    return met.where("m.fp <> c.fp").select("m", F.struct("c.number", "c.fp").alias("c")).select(*_pair("m", "c"))


def unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members whose key holds more than one component, with their root, and ``large``: whether the key's texts are more than one block."""
    own = members.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    many = own.groupBy("key").agg(F.count("*").alias("n"), F.sum("chars").alias("all"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    return own.join(many.select("key", F.expr(f"n > {BLOCK} OR all > {BLOCK_CHARS}").alias("large")), "key")


def dealt(members: DataFrame) -> DataFrame:
    """key, number, fp, root, and a pair of blocks (low, high) with its own ``block``, of the members of ``unsettled``, once for each pair they meet in.

    Any two members of a key and different roots meet in one pair: in (b, b) if both are of block b, else in that of
    their blocks. The blocks of the key's most frequent root come first and don't meet each other.
    """
    columns = ["key", "number", "fp", "root"]
    small = members.where("NOT large").select(*columns, *(F.lit(0).cast("long").alias(c) for c in ("low", "high", "block")))
    large = members.where("large")
    of_root = large.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    of_key = of_root.groupBy("key").agg(F.max(F.struct("n", "chars", "root")).alias("most"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    blocks = lambda n, chars: F.greatest(F.ceil(n / BLOCK), F.ceil(chars / BLOCK_CHARS))
    most = blocks(F.col("most.n"), F.col("most.chars")).alias("firsts")
    rest = blocks(F.col("n") - F.col("most.n"), F.col("chars") - F.col("most.chars")).alias("others")
    own = large.join(of_key.select("key", F.col("most.root").alias("most"), most, rest), "key")
    place = F.xxhash64("number", "key")
    first = F.col("root") == F.col("most")
    own = own.withColumn("block", F.when(first, F.pmod(place, "firsts")).otherwise(F.col("firsts") + F.pmod(place, "others")))
    met = F.sequence(F.when(first, F.col("firsts")).otherwise(0), F.col("firsts") + F.col("others") - 1)
    own = own.withColumn("other", F.explode(met))
    return small.union(own.select(*columns, F.least("block", "other"), F.greatest("block", "other"), "block"))


def _hashed(text: str) -> np.ndarray:
    return np.unique(np.concatenate([np.unique(x) for x in simhash.hashes_of(text, SHINGLE)]))


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``left`` has in common with each of ``right``; all are sorted and distinct."""

    def flags(arrays, values):
        out = np.zeros((len(arrays), len(values)), np.float32)
        for row, own in zip(out, arrays):
            own = own[np.searchsorted(own, values[0]) : np.searchsorted(own, values[-1], "right")]
            at = np.searchsorted(values, own)
            row[at[values[at] == own]] = 1
        return out

    if left is right:
        values, times = np.unique(np.concatenate(left), return_counts=True)
        values = values[times > 1]
    else:
        values = np.intersect1d(np.concatenate(left), np.concatenate(right))
    counts = np.zeros((len(left), len(right)), np.int64)
    for i in range(0, len(values), COLUMNS):
        some = values[i : i + COLUMNS]
        one = flags(left, some)
        # Sums of at most COLUMNS ones are exact in single precision.
        counts += (one @ (one if left is right else flags(right, some)).T).astype(np.int64)
    return counts


def _links(left: list[tuple], right: list[tuple]) -> list[tuple[int, int]]:
    """Links (by fp) that join the near copies of the (fp, root, hashes) of one side and the other, or of one list, across their roots."""
    top = {root: root for _, root, _ in [*left, *right]}
    if len(top) < 2 or not left or not right:
        return []

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    one = [x[2] for x in left]
    two = one if left is right else [x[2] for x in right]
    both = _shared(one, two)
    near = both >= SIMILARITY * (np.array([len(x) for x in one])[:, None] + np.array([len(x) for x in two]) - both)
    near &= np.array([x[1] for x in left])[:, None] != np.array([x[1] for x in right])
    out = []
    for i, j in np.argwhere(near):
        a, b = find(left[i][1]), find(right[j][1])
        if a != b:
            top[a] = b
            out.append((left[i][0], right[j][0]))
    return out


def gathered(members: DataFrame, texts: DataFrame) -> DataFrame:
    """u and v: links between the components of each key of ``unsettled``, found by comparing all its members of different ones."""

    def table(links):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["u", "v"])

    def run(batches):
        pair, sides = None, {}

        def found():
            # One block meets itself, or the second of two.
            return _links(sides.get(pair[1], []), sides.get(pair[2], [])) if pair else []

        for batch in batches:
            links = []
            for key, low, high, block, fp, root, text in zip(*batch.columns):
                if (own := (key.as_py(), low.as_py(), high.as_py())) != pair:
                    links += found()
                    pair, sides = own, {}
                sides.setdefault(block.as_py(), []).append((fp.as_py(), root.as_py(), _hashed(text.as_py())))
            yield table(links)
        yield table(found())

    own = dealt(members).join(_texts_of(members, texts), "number")
    rows = own.select("key", "low", "high", "block", "fp", "root", "text").repartition("key", "low", "high")
    return rows.sortWithinPartitions("key", "low", "high").mapInArrow(run, "u bigint, v bigint")


def _texts_of(members: DataFrame, texts: DataFrame) -> DataFrame:
    return common.written(texts.select("number", "text").join(members.select("number").distinct(), "number", "left_semi"), "candidate-texts")


def alike(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The distinct pairs whose marks agree in ``AGREE`` places at least; ``found`` is of ``prints``."""
    marks = found.select("number", "marks")
    one = pairs.dropDuplicates(["a", "b"]).join(marks.toDF("a", "x"), "a")
    both = one.join(marks.toDF("b", "y"), "b")
    return both.where(F.size(F.filter(F.zip_with("x", "y", lambda x, y: x == y), lambda same: same)) >= AGREE).select("a", "b", "u", "v")


def verified(pairs: DataFrame, rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """u and v of the pairs whose texts are at least ``least`` similar."""

    def run(batches):
        for batch in batches:
            good = [similarity(a.as_py(), b.as_py()) >= least for a, b in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("number")), rows)
    one = pairs.join(texts.select(F.col("number").alias("a"), F.col("text").alias("x")), "a")
    both = one.join(texts.select(F.col("number").alias("b"), F.col("text").alias("y")), "b")
    return both.select("u", "v", "x", "y").mapInArrow(run, "u bigint, v bigint")


def classes(found: DataFrame, texts: DataFrame) -> DataFrame:
    """fp and root of every linked ``fp``; ``found`` is of ``prints``, ``texts`` has number and text of the same rows."""

    def grouped(links: DataFrame) -> DataFrame:
        return common.written(components(links).withColumnRenamed("node", "fp"), "components")

    members = found.select("number", "fp", "chars", F.explode("keys").alias("key"))
    picked = verified(common.written(alike(candidates(members), found), "candidates"), texts)
    links = common.written(simhash.links(found.select("fp").distinct()).union(picked), "links")
    roots = grouped(links)
    rest = common.written(unsettled(members, roots), "unsettled")
    if rest.isEmpty():
        return roots
    more = common.written(gathered(rest, texts), "links")
    return roots if more.isEmpty() else grouped(links.union(more))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the least doc_id; every column stays.

    Null doc_ids order last, and rows with one doc_id by their place in the input.
    """
    numbered = common.numbered(docs)
    texts = numbered.select("number", F.col("row.text").alias("text"))
    found = common.written(prints(texts), "prints")
    ids = numbered.select("number", F.struct(F.col("row.doc_id").isNull().alias("nil"), F.col("row.doc_id").alias("doc_id"), "number").alias("id"))
    of_class = found.select("number", "fp").join(ids, "number").groupBy("fp").agg(F.min("id").alias("least"))
    roots = classes(found, texts)
    keep = of_class.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("least").alias("least")).select("least.number")
    return numbered.join(keep, "number", "left_semi").select("row.*")
