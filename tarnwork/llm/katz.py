"""Language-model scores by Katz backoff.

Tokens are the lower-cased (A-Z) words of a text and one end. The model has word pairs and words. A
pair seen r times after a context c has d(r) * r / count(c), with d the Good-Turing discount for r up
to ``CUTOFF`` and 1 above. An unseen pair backs off to weight(c) times the probability of the word,
and weight(c) is exactly the mass that the discounts leave, divided by what the words not seen after
c hold. Words are discounted in the same way; the mass left is the probability of the one class of
unknown words, so every distribution sums to 1 over the V words and that class. A context all of
whose pairs are above ``CUTOFF`` leaves 1 / (count + 1). A context never seen has weight 1.

Documents are packed into chunks of about ``CHUNK`` tokens, as numbers into the chunk's own word
list, and written once. Words, then pairs, are counted and looked up in one exchange each: a chunk
sends each bucket of the hash space its distinct entries with their training counts, the bucket
merges them into its part of the count table, and answers with the totals. So a frequent word or pair
is one entry per chunk. A context is in one bucket, except the at most ``HOT`` contexts that hold
over 1 / ``HOT`` of all tokens: their pairs are spread over all buckets, and their sums are added up.
Words are keyed by their 64-bit XXH64. The number of buckets follows the number of tokens.

Training rows are those for which crc32 of the doc_id as text isn't 2 modulo 7; a null doc_id counts
as empty text there. Null and blank texts are the end alone. Repeated rows count and are scored each.
Without training rows all is unknown, with probability 1. An empty table gives an empty result;
other columns don't matter.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnwork.llm import common

CHUNK = 3_000_000
BUCKET = 2_000_000
HOT = 2_000
CUTOFF = 5
FOLDS, HELD = 7, 2
#: Neither can be a word. The end is a token; the start is only a context.
END, START = "\n", "\t"

_word = re.compile(common.WORD)


def pack(a: np.ndarray) -> bytes:
    """An array as bytes: first bytes of all items, then second bytes and so on, compressed; high bytes are mostly alike."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return a.dtype.str[-2:].encode() + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    kind = np.dtype("<" + bytes(blob[:2]).decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[2:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def chunks(docs: DataFrame) -> DataFrame:
    """Rows of packed documents: chunk, doc_ids, held, lengths, tokens (numbers into words) and words (their hashes)."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    arrow_type = pa.int64() if doc_type == "bigint" else None

    def run(batches):
        ids, lengths, tokens, words, total = [], [], [], _Numbers({START: 0, END: 1}), 0

        def row():
            texts = ["" if i is None else str(i) for i in ids]
            held = [zlib.crc32(t.encode()) % FOLDS == HELD for t in texts]
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            columns = [pa.array([ids], pa.list_(arrow_type) if arrow_type else None), pa.array([held], pa.list_(pa.bool_()))]
            columns += [pa.array([pack(x)], pa.binary()) for x in (np.array(lengths, np.uint32), np.concatenate(tokens), hashes)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([total], pa.int64())], ["doc_ids", "held", "lengths", "tokens", "words", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                own = _word.findall(common.ascii_lower_text(text.as_py() or ""))
                own.append(END)
                ids.append(doc_id.as_py())
                lengths.append(len(own))
                tokens.append(np.fromiter(map(words.__getitem__, own), np.uint32, len(own)))
                total += len(own)
                if total >= CHUNK:
                    yield row()
                    ids, lengths, tokens, words, total = [], [], [], _Numbers({START: 0, END: 1}), 0
        if ids:
            yield row()

    schema = f"doc_ids array<{doc_type}>, held array<boolean>, lengths binary, tokens binary, words binary, n bigint"
    rows = docs.select("doc_id", "text").mapInArrow(run, schema)
    return common.written(rows.withColumn("chunk", F.monotonically_increasing_id()), "chunks")


class Chunk:
    """A chunk row's arrays: token numbers, their contexts, training mask."""

    def __init__(self, row):
        self.id, self.doc_ids = row["chunk"], list(row["doc_ids"])
        self.held = np.array(row["held"], bool)
        self.lengths, self.tokens, self.words = (unpack(row[x]) for x in ("lengths", "tokens", "words"))
        self.ends = np.cumsum(self.lengths.astype(np.int64))
        self.starts = self.ends - self.lengths
        self.train = ~np.repeat(self.held, self.lengths)

    def word_order(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The words by bucket and hash, and where each bucket starts."""
        bucket = (self.words % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((self.words, bucket))
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))

    def pairs(self, counts: np.ndarray, n: int, buckets: int):
        """Distinct pairs by bucket, context and word: contexts, words, bucket starts; and each token's pair."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = 0
        both, of = np.unique(before.astype(np.uint64) << np.uint64(32) | self.tokens, return_inverse=True)
        del before
        of = of.astype(np.uint32)
        c, w = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        del both
        hash_w = self.words[w]
        spread = hash_w * np.uint64(0x9E3779B97F4A7C15)
        spread >>= np.uint64(7)
        spread[~is_hot(counts, n)[c]] = 0  # only the pairs of hot contexts are spread by their words
        hash_c = self.words[c]
        spread ^= hash_c
        spread %= np.uint64(buckets)
        bucket = spread.astype(np.int32)
        del spread
        order = np.lexsort((hash_w, hash_c, bucket)).astype(np.uint32)
        del hash_w, hash_c
        place = np.empty_like(order)
        place[order] = np.arange(len(order), dtype=np.uint32)
        return c[order], w[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), place[of]


def is_hot(counts: np.ndarray, n: int) -> np.ndarray:
    """By context count; the start's is that of the end, put in its place."""
    return counts * HOT > n


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """Good-Turing discounts d(0..CUTOFF) from the numbers of entries seen 1 .. CUTOFF + 1 times; d(0) is unused.

    Where the numbers don't give a discount between 0 and 1, half a count is taken off instead.
    """
    d = np.ones(CUTOFF + 1)
    n = np.append(0.0, of_counts)
    top = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUTOFF + 1):
        value = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top < 1 else 0.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


def discounted(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(r <= CUTOFF, d[np.minimum(r, CUTOFF).astype(np.int64)], 1.0) * r


class Words:
    """Probabilities of words from their counts; ``of_counts`` are the numbers of words seen 1 .. CUTOFF + 1 times."""

    def __init__(self, n: int, of_counts: np.ndarray):
        self.n, self.d = n, discounts(of_counts)
        r = np.arange(1, CUTOFF + 1)
        left = float(((1 - self.d[1:]) * r * of_counts[:CUTOFF]).sum()) / n if n else 1.0
        least = 1 / (n + 1)
        self.unknown = max(left, least)
        self.scale = (1 - self.unknown) / (1 - left) if left < 1 else 0.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones(len(counts))
        return np.where(counts > 0, self.scale * discounted(counts, self.d) / self.n, self.unknown)


def _of_counts(r: np.ndarray) -> list[int]:
    return [int(x) for x in np.bincount(np.minimum(r, CUTOFF + 2).astype(np.int64), minlength=CUTOFF + 3)[1 : CUTOFF + 2]]


_ANSWER = "level int, chunk long, bucket int, counts binary, contexts binary, stats array<long>, hot array<struct<hash: bigint, of_counts: array<bigint>, total: bigint, held: double>>"


def _answer(level, chunk, bucket, counts=None, contexts=None, stats=None, hot=None):
    return {"level": level, "chunk": chunk, "bucket": bucket, "counts": counts, "contexts": contexts, "stats": stats, "hot": hot}


def ask_words(rows: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.select(["chunk", "doc_ids", "held", "lengths", "tokens", "words"]).to_pylist():
                own = Chunk(row)
                counts = np.bincount(own.tokens[own.train], minlength=len(own.words)).astype(np.uint64)
                order, at = own.word_order(buckets)
                for b in range(buckets):
                    part = order[at[b] : at[b + 1]]
                    if len(part):
                        yield pa.RecordBatch.from_pylist([{"bucket": b, "chunk": own.id, "keys": pack(own.words[part]), "counts": pack(counts[part])}], schema=schema)

    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    return rows.mapInArrow(run, "bucket int, chunk long, keys binary, counts binary")


def merge_words(pdf: pd.DataFrame) -> pd.DataFrame:
    keys, counts = [unpack(x) for x in pdf["keys"]], [unpack(x) for x in pdf["counts"]]
    _, of = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(of, np.concatenate(counts)).astype(np.uint64)
    bucket, at, out = pdf["bucket"].iloc[0], 0, []
    for chunk, own in zip(pdf["chunk"], keys):
        out.append(_answer(1, chunk, bucket, pack(total[of[at : at + len(own)]])))
        at += len(own)
    out.append(_answer(1, None, bucket, stats=[int((total > 0).sum()), int(total.sum()), *_of_counts(total)]))
    return pd.DataFrame(out)


def word_counts(own: Chunk, answers: pd.DataFrame, buckets: int) -> np.ndarray:
    """Training counts of the chunk's words; in the start's place, those of the end."""
    order, at = own.word_order(buckets)
    counts = np.zeros(len(own.words), np.int64)
    for b, blob in zip(answers["bucket"], answers["counts"]):
        counts[order[at[b] : at[b + 1]]] = unpack(blob).astype(np.int64)
    counts[0] = counts[1]
    return counts


def merge_pairs(words: Words, n: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # For each row: contexts' hashes, whether hot, numbers of pairs; hashes and counts of the words; pairs' words and training counts.
        sent = [[unpack(x) for x in pdf[c]] for c in ("contexts", "hot", "sizes", "keys", "counts", "seen")]
        for i, number in enumerate(pdf["numbers"]):
            number = unpack(number)
            sent[3][i], sent[5][i] = sent[3][i][number], sent[5][i][number]
        hash_c, hot, sizes, hash_w, counts, seen = (np.concatenate(x) for x in sent)
        n_contexts, n_pairs = [len(x) for x in sent[0]], [len(x) for x in sent[3]]
        # Contexts get numbers, so that pairs are sorted by one key and the word.
        contexts, number = np.unique(hash_c, return_inverse=True)
        hot_context = np.zeros(len(contexts), bool)
        hot_context[number] = hot.astype(bool)
        c = np.repeat(number, sizes)
        order = np.lexsort((hash_w, c))
        sorted_c, sorted_w = c[order], hash_w[order]
        new = np.append(True, (sorted_c[1:] != sorted_c[:-1]) | (sorted_w[1:] != sorted_w[:-1]))
        of = np.empty(len(c), np.int64)
        of[order] = np.cumsum(new) - 1
        r = np.bincount(of, counts).astype(np.int64)
        context_of, p = sorted_c[new], words.probability(seen[order][new].astype(np.int64))
        k = len(contexts)
        by_count = np.stack([np.bincount(context_of[r == i], minlength=k) for i in range(1, CUTOFF + 1)], 1)
        total = np.bincount(context_of, r, k).astype(np.int64)
        held = np.bincount(context_of[r > 0], p[r > 0], k)
        bucket, i, j, out = pdf["bucket"].iloc[0], 0, 0, []
        for chunk, m, q in zip(pdf["chunk"], n_contexts, n_pairs):
            own = number[i : i + m]
            table = np.column_stack([by_count[own], total[own], held[own].view(np.int64)])
            out.append(_answer(2, chunk, bucket, pack(r[of[j : j + q]].astype(np.uint64)), pack(table.ravel())))
            i, j = i + m, j + q
        shared = [{"hash": int(contexts[x].view(np.int64)), "of_counts": by_count[x].tolist(), "total": int(total[x]), "held": float(held[x])} for x in np.flatnonzero(hot_context)]
        out.append(_answer(2, None, bucket, stats=_of_counts(r), hot=shared))
        return pd.DataFrame(out)

    return run


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    rows = chunks(docs)
    tokens = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-tokens // BUCKET))

    asked = ask_words(rows, buckets)
    answers = common.written(asked.groupBy("bucket").applyInPandas(merge_words, _ANSWER), "word-counts")
    sums = answers.where("chunk IS NULL").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n"))
    sums = {r.pos: r.n for r in sums.collect()}  # CUTOFF + 3 numbers
    v, n = sums.get(0, 0), sums.get(1, 0)
    words = Words(n, np.array([sums.get(i + 2, 0) for i in range(CUTOFF + 1)], np.float64))

    def ask_pairs(own_rows: pd.DataFrame, own_answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in own_rows.iterrows():
            own = Chunk(row)
            seen = word_counts(own, own_answers, buckets)
            c, w, at, of = own.pairs(seen, n, buckets)
            counts = np.bincount(of[own.train], minlength=len(c)).astype(np.uint64)
            hot = is_hot(seen, n)
            for b in range(buckets):
                part = slice(at[b], at[b + 1])
                if at[b] == at[b + 1]:
                    continue
                first = np.flatnonzero(np.append(True, c[part][1:] != c[part][:-1]))
                sizes = np.diff(np.append(first, at[b + 1] - at[b])).astype(np.uint32)
                # Words once each, with their counts; pairs refer to them by number.
                used, number = np.unique(w[part], return_inverse=True)
                blobs = own.words[c[part][first]], hot[c[part][first]].astype("<u1"), sizes, own.words[used], number.astype(np.uint32), counts[part], seen[used]
                out.append([b, own.id, *map(pack, blobs)])
        return pd.DataFrame(out, columns=["bucket", "chunk", "contexts", "hot", "sizes", "keys", "numbers", "counts", "seen"])

    by_chunk = rows.groupBy("chunk").cogroup(answers.where("chunk IS NOT NULL").groupBy("chunk"))
    asked = by_chunk.applyInPandas(ask_pairs, "bucket int, chunk long, contexts binary, hot binary, sizes binary, keys binary, numbers binary, counts binary, seen binary")
    pair_answers = common.written(asked.groupBy("bucket").applyInPandas(merge_pairs(words, n), _ANSWER), "pair-counts")
    own_stats = pair_answers.where("chunk IS NULL")
    sums = own_stats.select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    d = discounts(np.array([x for _, x in sorted((r.pos, r.n) for r in sums)] or [0] * (CUTOFF + 1), np.float64))
    hot_rows = own_stats.select(F.explode("hot").alias("h")).groupBy("h.hash")
    hot_sums = hot_rows.agg(*(F.sum(F.col("h.of_counts")[i]).alias(f"n{i}") for i in range(CUTOFF)), F.sum("h.total").alias("total"), F.sum("h.held").alias("held"))
    # At most HOT + 1 contexts.
    hot_table = {r.hash: [*(r[f"n{i}"] for i in range(CUTOFF)), r.total, r.held] for r in hot_sums.collect()}

    def finish(own_rows: pd.DataFrame, all_answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in own_rows.iterrows():
            own = Chunk(row)
            seen = word_counts(own, all_answers[all_answers["level"] == 1], buckets)
            c, w, at, of = own.pairs(seen, n, buckets)
            r = np.zeros(len(c), np.int64)
            table = np.zeros((len(own.words), CUTOFF + 2))
            for b, counts, contexts in all_answers.loc[all_answers["level"] == 2, ["bucket", "counts", "contexts"]].itertuples(index=False):
                part = slice(at[b], at[b + 1])
                r[part] = unpack(counts).astype(np.int64)
                blob = unpack(contexts).reshape(-1, CUTOFF + 2)
                first = np.append(True, c[part][1:] != c[part][:-1])
                own_c = c[part][first]
                table[own_c, :-1] = blob[:, :-1]
                table[own_c, -1] = np.ascontiguousarray(blob[:, -1]).view(np.float64)
            for at_word in np.flatnonzero(is_hot(seen, n)):
                if (sums_of := hot_table.get(int(own.words[at_word].view(np.int64)))) is not None:
                    table[at_word] = sums_of
            # Mass left by the discounts of a context, over what the words not seen after it hold.
            few, total, held = table[:, :CUTOFF], table[:, CUTOFF], table[:, CUTOFF + 1]
            known = total > 0
            whole = known & (few.sum(1) == 0)
            left = ((1 - d[1:]) * np.arange(1, CUTOFF + 1) * few).sum(1) / np.maximum(total, 1)
            left = np.where(whole, 1 / (total + 1), left)
            scale = np.where(whole, total / (total + 1), 1.0)
            weight = np.where(known, left / np.maximum(1 - held, words.unknown), 1.0)
            p = words.probability(seen[w])
            pair = np.where(r > 0, scale[c] * discounted(r, d) / np.maximum(total[c], 1), weight[c] * p)
            log_pair = np.log10(pair)
            log_base = np.log10((seen + 1) / (n + (v + 1)))
            score = np.add.reduceat(log_pair[of], own.starts)
            base = np.add.reduceat(log_base[own.tokens], own.starts)
            n_known = np.add.reduceat((seen[own.tokens] > 0).astype(np.int64), own.starts)
            out.append(pd.DataFrame({"doc_id": own.doc_ids, "held_out": own.held, "n_tokens": own.lengths.astype(np.int64), "n_known": n_known, "train_tokens": n, "base_score": base, "score": score}))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    every = answers.union(pair_answers).where("chunk IS NOT NULL").select("level", "chunk", "bucket", "counts", "contexts")
    schema = f"doc_id {doc_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("chunk").cogroup(every.groupBy("chunk")).applyInPandas(finish, schema)


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents"))
