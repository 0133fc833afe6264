"""Packing tokenised documents into windows by Karmarkar-Karp multiway differencing.

A document is its token ids and the end id 1. Runs of ``WINDOW`` ids from its start fill windows of
their own; the rest is cut into pieces of at most ``PIECE`` ids. Pieces are dealt by a hash of their
row into blocks of about ``BLOCK_WINDOWS`` windows. In a block, differencing starts from partial
partitions with one piece each (pieces below ``BUNDLE`` ids are first joined with their neighbours), and again and again merges the two with the greatest imbalance so
that the fullest windows of one meet the emptiest of the other, until one near-equal partition is
left. If its fullest window exceeds the capacity, the block takes one more window and starts anew.

Null and blank texts are the end id alone. Repeated rows and repeated doc_ids are packed each. Other
columns don't matter; an empty table gives an empty result. Very long texts are cut like all others.
A call holds the rows of one block, WINDOW * BLOCK_WINDOWS one-id pieces at most on average, and
differencing at most WINDOW * BLOCK_WINDOWS / BUNDLE partitions of BLOCK_WINDOWS numbers.
"""

from __future__ import annotations

import heapq
import os
import unicodedata
import zlib
from array import array
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnwork.llm import common

WINDOW = 2048
PIECE = 512
BLOCK_WINDOWS = 256
#: Pieces shorter than this are joined to bundles of less than twice as much before differencing.
BUNDLE = 64
END = 1
#: Most words whose ids a worker remembers, twice: of the current generation and the one before. Between tasks it keeps the words met first, mostly frequent ones.
REMEMBERED = 300_000
KEPT = 50_000

#: White space to Python but not to the tokenizer's patterns; and starts of special tokens. Such texts are encoded whole.
_WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")


class WordIds(dict):
    """Ids of words (runs without white space) as bytes, encoded on first use.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in turn.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.before: dict[str, bytes] = {}
        # Fixed rule of byte-level vocabularies: printable Latin-1 bytes stand for themselves, others follow from U+0100.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.of_byte = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        import regex

        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.stops = {x: self.of_part(x) for x in ".,"}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(word)
        if ids is None:
            ids = self.encoded(word)
        self[word] = ids
        return ids

    def rest(self) -> None:
        """Lets go of most words at the end of a task; workers live on and hold their memory through other stages."""
        first = dict(islice((self.before or self).items(), KEPT))
        self.before = {}
        self.clear()
        self.update(first)

    def encoded(self, word: str) -> bytes:
        if word.isascii():
            low = word.lower()
        elif max(word) >= "ɐ":  # beyond Latin, all is left to the library
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        else:
            low = unicodedata.normalize("NFC", word).lower()
        if low.isalpha():
            return self.of_part(low)
        if low[-1] in ".," and low[:-1].isalpha():
            return self.of_part(low[:-1]) + self.stops[low[-1]]
        return b"".join(map(self.of_part, self.parts.findall(low)))

    def of_part(self, part: str) -> bytes:
        if not (part.isascii() and part.isprintable()):
            part = "".join(map(self.of_byte.__getitem__, part.encode()))
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def of_text(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if any(x in text for x in _WHOLE):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.split()))


_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _ids:
        _ids[path] = WordIds(path)
    return _ids[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cuts(n: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces."""
    full = n - n % WINDOW
    out = [(i, WINDOW) for i in range(0, full, WINDOW)]
    return out + [(i, min(PIECE, n - i)) for i in range(full, n, PIECE)]


def pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    end = array("I", [END]).tobytes()

    def run(batches):
        ids = word_ids(tokenizer)
        for batch in batches:
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                own = ids.of_text(text.as_py() or "") + end
                n = len(own) // 4
                for start, length in cuts(n):
                    rows.append(i)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(own[4 * start : 4 * (start + length)]))
                    totals.append(n)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        ids.rest()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part (0 to k - 1) of each size in a near-equal partition into k parts."""
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, np.int64)
    # A partial partition: sums of its parts in ascending order, less their least, and a node of the merge tree.
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    left, right, order = {}, {}, {}
    one = np.zeros(k, np.int64)
    for node in range(n, 2 * n - 1):
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums.pop(a, None), sums.pop(b, None)
        if x is None:
            x = one.copy()
            x[-1] = sizes[a]
        if y is None:
            y = one.copy()
            y[-1] = sizes[b]
        both = x + y[::-1]
        by = np.argsort(both, kind="stable").astype(np.int32)
        both = both[by]
        both -= both[0]
        sums[node], left[node], right[node], order[node] = both, a, b, by
        heapq.heappush(heap, (-int(both[-1]), node))
    # Down the tree: place[j] is the final part of a node's j-th part.
    part = np.zeros(n, np.int64)
    stack = [(2 * n - 2, np.arange(k))]
    while stack:
        node, place = stack.pop()
        if node < n:
            part[node] = place[-1]
            continue
        own = np.empty(k, np.int64)
        own[order[node]] = place
        stack.append((left[node], own))
        stack.append((right[node], own[::-1]))
    return part


def packed(sizes: np.ndarray, capacity: int = WINDOW) -> np.ndarray:
    """The window of each size; the window count starts at the least possible and rises while one is over capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        part = difference(sizes, k)
        if np.bincount(part, sizes).max(initial=0) <= capacity:
            return part
        k += 1


def bundled(sizes: np.ndarray) -> np.ndarray:
    """The number of each size's bundle: sizes below ``BUNDLE`` are joined, in order, with those around them; others are alone."""
    small = sizes < BUNDLE
    before = np.cumsum(np.where(small, sizes, 0)) - np.where(small, sizes, 0)
    # Small sizes by the stretch of BUNDLE ids that they begin in, large ones by their place.
    key = np.where(small, before // BUNDLE, len(sizes) + np.arange(len(sizes)) + before[-1:].sum())
    return np.unique(key, return_inverse=True)[1].ravel()


def pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("uid", ignore_index=True)
    # A block of very short texts has up to WINDOW * BLOCK_WINDOWS pieces, but few bundles.
    sizes = pdf["length"].to_numpy()
    of = bundled(sizes)
    part = packed(np.bincount(of, sizes).astype(np.int64))[of]
    pdf["sequence_id"] = 2 * (pdf["block"] * (1 << 30) + part)
    offset = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
    return pdf.assign(offset=offset)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = pieces(docs, tokenizer or default_tokenizer())
    cut = common.written(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == WINDOW).withColumn("sequence_id", 2 * F.col("uid") + 1).withColumn("offset", F.lit(0).cast("long")).drop("uid")
    rest = cut.where(F.col("length") < WINDOW)
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, round(tokens / (BLOCK_WINDOWS * WINDOW)))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return full.unionByName(rest.groupBy("block").applyInPandas(pack_block, schema))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
