"""SimHash near-duplicates by multi-index hashing.

Text is lower-cased (A-Z) and split into words at ASCII white space; every run of three words
(fewer words: all of them) is hashed with XXH64, seed 42, repeats included. A fingerprint bit is 1
if set in more than half of the hashes. Fingerprints at most ``RADIUS`` bits apart are linked.

Each distinct fingerprint is one class, so copies never meet as pairs. A class is entered in two
tables by the two 32-bit halves of its fingerprint. Of two fingerprints at most 3 bits apart, one
half differs in at most one bit, so each half is looked up under itself and under every value of its
Hamming ball of radius 1. Of two halves one bit apart exactly one has that bit clear, so only clear
bits need to be set. Matches are verified on all 64 bits, in the join.

Null and blank texts have fingerprint zero and are linked like any other. A null doc_id never names
a component unless it is alone. Repeated rows share a class. Other columns don't matter; an empty
table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnwork.llm import common
from tarnwork.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Shingles of a text that are counted at once.
BLOCK = 1 << 16

_word = re.compile(common.WORD)


def shingles(text: str, k: int) -> list[str]:
    words = _word.findall(common.ascii_lower_text(text))
    if len(words) <= k:
        return [" ".join(words)] if words else []
    return list(map(" ".join, zip(*(words[i:] for i in range(k)))))


def hashes_of(text: str, k: int, block: int = BLOCK):
    """Hashes of the shingles in arrays of at most ``block``; a long text's shingles are never held all at once."""
    words = _word.findall(common.ascii_lower_text(text))
    for i in range(0, max(len(words) - k + 1, min(len(words), 1)), block):
        own = words[i : i + block + k - 1]
        parts = map(" ".join, zip(*(own[j:] for j in range(k)))) if len(words) > k else [" ".join(words)]
        yield np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), np.uint64)


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in hashes_of(text or "", k):
        total += len(hashes)
        # Most significant bit first; sums of bytes stay below 256 in groups of 255.
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total).view(">i8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and fp (bigint) of every row."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            values = [fingerprint(t.as_py(), k) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, fp bigint")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints ``fp`` of ``nodes`` that are at most ``radius`` <= 3 bits apart."""
    if not 0 <= radius <= 3:
        raise ValueError("two halves with balls of one bit find all pairs up to 3 bits apart")
    half = lambda i: (F.shiftrightunsigned("fp", 32 * i) if i else F.col("fp")).bitwiseAND(F.lit(0xFFFFFFFF))
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), half(i).alias("value")) for i in range(2)))).alias("p")
    entries = nodes.select("fp", parts).select("fp", "p.part", "p.value")
    ball = F.expr("concat(array(value), transform(filter(sequence(0, 31), b -> getbit(value, b) = 0), b -> value | shiftleft(1L, b)))")
    probes = entries.select(F.col("fp").alias("u"), "part", F.explode(ball).alias("value"))
    found = probes.join(entries.select(F.col("fp").alias("v"), "part", "value"), ["part", "value"])
    return found.where((F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius) & (F.col("u") != F.col("v"))).select("u", "v")


def grouped(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    prints = common.written(fingerprints(docs, k), "fingerprints")
    nodes = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = common.written(components(links(nodes.select("fp"), radius)), "components")
    of_class = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.written(of_class.join(ids, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the least doc_id; every column stays.

    Null doc_ids order last, and rows with one doc_id by their place in the input.
    """
    numbered = common.numbered(docs)
    doc_id = F.col("row.doc_id")
    ids = numbered.select(F.struct(doc_id.isNull().alias("nil"), doc_id.alias("id"), "number").alias("doc_id"), F.col("row.text").alias("text"))
    keep = grouped(ids).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.number").alias("number"))
    return numbered.join(keep, "number", "left_semi").select("row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouped(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
