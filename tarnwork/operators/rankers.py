"""Three rankers of scopes for a query, as ranked hits: vector, symbol name and keyword.

A hit is ranker, weight, rank, confidence, id, file_path, line_start, line_end, content. Candidates
have id, file_path, name, kind, line_start, line_end, source and seq (their order, which breaks ties).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tarnwork.functions import text as tx
from tarnwork.operators import vectors
from tarnwork.operators.ranking import ranked
from tarnwork.sources.readers import spread, written

# Weights of the rankers; confidences of name matches; hits that count as certain.
VECTOR, SYMBOL, KEYWORD = ("vector", 1.15), ("ast", 1.00), ("regex", 0.85)
EQUAL, PREFIX, WITHIN, ALIKE, LEAST_ALIKE = 1.0, 0.88, 0.72, 0.85, 0.6
CERTAIN_HITS = 4
HIT = ("ranker", "weight", "rank", "confidence", "id", "file_path", "line_start", "line_end", "content")


def query_tokens(query: str) -> list[str]:
    """Lower-cased runs of two or more ASCII letters, digits and underscores, repeats kept."""
    return [t.lower() for t in re.findall("[A-Za-z0-9_]{2,}", query)]


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / longest))


def _hits(candidates: DataFrame, scored: DataFrame, ranker: tuple[str, float], *order: Column, limit: int | None = None) -> DataFrame:
    """``scored`` has seq, confidence and what the order needs; texts are joined to the ranks, not sorted with them."""
    out = ranked(scored, *order, "seq", limit=limit).join(candidates, "seq")
    return out.withColumn("ranker", F.lit(ranker[0])).withColumn("weight", F.lit(ranker[1])).withColumnRenamed("source", "content").select(*HIT)


def embedded(candidates: DataFrame) -> DataFrame:
    """seq and the counts of "name kind source", which don't depend on a query."""
    return vectors.counted(candidates.select("seq", F.concat_ws(" ", "name", "kind", "source").alias("blob")), "seq", "blob")


def vector_hits(candidates: DataFrame, counts: DataFrame, lengths: DataFrame, idf: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """All candidates by cosine of their ``embedded`` counts; those that share nothing with the query have 0."""
    similar = vectors.similarities(query, counts, lengths, "seq", idf)
    scored = candidates.select("seq").join(similar, "seq", "left").select("seq", F.coalesce("similarity", F.lit(0.0)).alias("confidence"))
    return _hits(candidates, scored, VECTOR, F.desc("confidence"), limit=limit)


def name_confidence(name: Column, token: Column) -> Column:
    alike = edit_similarity(name, token)
    near = F.when(alike >= LEAST_ALIKE, alike * ALIKE).otherwise(0.0)
    return F.when(name == token, EQUAL).when(name.startswith(token) | token.startswith(name), PREFIX).when(name.contains(token), WITHIN).otherwise(near)


def symbol_hits(candidates: DataFrame, query: str) -> DataFrame:
    """Candidates by their name's best match with a token of the query."""
    name = tx.ascii_lower(F.col("name"))
    tokens = F.array(*map(F.lit, dict.fromkeys(query_tokens(query)))) if query_tokens(query) else F.array().cast("array<string>")
    best = F.coalesce(F.array_max(F.transform(tokens, lambda t: name_confidence(name, t))), F.lit(0.0))
    return _hits(candidates, candidates.select("seq", best.alias("confidence")).where("confidence > 0"), SYMBOL, F.desc("confidence"))


def keyword_count(text: Column, query: str) -> Column:
    """Whole-word occurrences of the query's tokens, any case."""
    tokens = query_tokens(query)
    return F.regexp_count(text, F.lit(r"(?iU)\b(?:" + "|".join(tokens) + r")\b")) if tokens else F.lit(0)


def keyword_hits(candidates: DataFrame, query: str) -> DataFrame:
    """Candidates by the number of keyword hits; confidence is a quarter of it, or the share of the words, up to 1."""
    words = F.regexp_count("source", F.lit(rf"[^{tx.WHITE}]++"))
    # Written: a range sort reads its input twice.
    scored = written(spread(candidates.select("seq", "source")).select("seq", keyword_count(F.col("source"), query).alias("hits"), words.alias("words")).where("hits > 0"), "keyword-counts")
    density = F.col("hits") / F.greatest("words", F.lit(1))
    confidence = F.greatest(F.least(F.col("hits") / float(CERTAIN_HITS), F.lit(1.0)), F.least(density, F.lit(1.0)))
    return _hits(candidates, scored.select("seq", "hits", confidence.alias("confidence")), KEYWORD, F.desc("hits"), F.desc("confidence"))
