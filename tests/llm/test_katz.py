"""Katz scores against a plain dictionary model, and normalised distributions."""

import functools
import math
import os
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tarnwork.llm import katz

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def good_turing(counts, k=5):
    """Discounts by Katz's formula in fractions: (r* / r - common) / (1 - common), r* = (r + 1) n(r + 1) / n(r); half a count off where that isn't between 0 and 1."""
    n = Counter(counts.values())
    common = Fraction((k + 1) * n[k + 1], n[1]) if n[1] else Fraction(1)
    out = {}
    for r in range(1, k + 1):
        own = (Fraction((r + 1) * n[r + 1], r * n[r]) - common) / (1 - common) if n[r] and common < 1 else Fraction(0)
        out[r] = float(own if 0 < own < 1 else Fraction(2 * r - 1, 2 * r))
    return out


def plain(rows):
    """Scores by dictionaries, straight from the definition; and the function P(word | context)."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[*WORD.findall(lower(t)), "\n"] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    uni, bi = Counter(), Counter()
    for own, h in zip(tokens, held):
        if not h:
            uni.update(own)
            bi.update(zip(["\t", *own], own))
    n, v = sum(uni.values()), len(uni)
    du, db = good_turing(uni), good_turing(bi)
    disc = lambda r, d: r * d.get(r, 1.0)
    left = 1 - sum(disc(c, du) for c in uni.values()) / n if n else 1.0
    unknown = max(left, 1 / (n + 1))
    p1 = lambda w: (1 - unknown) / (1 - left) * disc(uni[w], du) / n if uni[w] else unknown
    after = defaultdict(dict)
    for (c, w), r in bi.items():
        after[c][w] = r

    @functools.cache
    def of_context(c):
        own = after[c]
        total = sum(own.values())
        scale = total / (total + 1) if all(r > katz.CUTOFF for r in own.values()) else 1.0
        seen = sum(scale * disc(r, db) / total for r in own.values())
        return total, scale, (1 - seen) / (1 - sum(p1(x) for x in own))

    def p2(w, c):
        if c not in after:
            return p1(w)
        total, scale, weight = of_context(c)
        return scale * disc(after[c][w], db) / total if w in after[c] else weight * p1(w)

    out = [(h, len(t), sum(x in uni for x in t), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in t), sum(math.log10(p2(w, c)) for c, w in zip(["\t", *t], t))) for t, h in zip(tokens, held)]
    return out, p2, uni, after


TEXTS = [
    (1, "the cat sat on the mat the cat ran"), (2, "The DOG sat on the mat"), (3, None), (4, ""), (5, "  "), (6, "the cat sat on the mat the cat ran"),
    (7, "zebra quagga"), (8, "über den Wolken the cat"), (9, "the the the the the the the the cat"), (None, "the cat"), (6, "the cat sat on the mat the cat ran"), (10, "x " * 500),
]
TEXTS += [(20 + i, f"the cat w{i} w{i // 2} w{i // 3} sat on w{i % 5} mat") for i in range(60)]


@pytest.mark.parametrize("chunk", [30, 3_000_000])
def test_matches_plain_model(spark, monkeypatch, chunk):
    monkeypatch.setattr(katz, "CHUNK", chunk)
    docs = spark.createDataFrame([(i, t, 5, 0.5) for i, t in TEXTS], "doc_id long, text string, n int, score double").coalesce(2)
    got = katz.scores(docs).collect()
    expected, *_ = plain(TEXTS)
    key = lambda i, x: (-1 if i is None else i, *map(float, x))
    a = sorted(key(r.doc_id, (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in got)
    b = sorted(key(i, x) for (i, _), x in zip(TEXTS, expected))
    assert np.allclose(a, b, rtol=1e-9)


def test_plain_model_is_normalised():
    _, p2, uni, after = plain(TEXTS)
    for context in [*after, "never seen"]:
        assert abs(sum(p2(w, context) for w in [*uni, "unknown word"]) - 1) < 1e-9


def test_empty_and_untrained(spark):
    schema = "doc_id long, text string"
    assert katz.scores(spark.createDataFrame([], schema)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = katz.scores(spark.createDataFrame([(held, "a b")], schema)).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_matches_plain_model_on_documents(spark):
    """Some contexts are spread over the buckets here, most aren't."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    expected, _, uni, _ = plain(rows)
    hot = [w for w, c in uni.items() if c * katz.HOT > sum(uni.values())]
    assert 0 < len(hot) < len(uni) / 10
    got = {r.doc_id: r for r in katz.scores(docs.repartition(4)).collect()}
    for (i, _), (held, n, known, total, base, score) in zip(rows, expected):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
