"""Near copies of five-word similarity against brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnwork.llm import near, simhash
from tests.llm.test_dedup import frame, near_rows


def brute_links(rows):
    sets = [set(simhash.shingles(t or "", 5)) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] | sets[j]]
    return [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


def brute_kept(rows):
    """Of each group, by links of three bits or of five-word similarity, the place of the row with the least doc_id, null last."""
    parent = list(range(len(rows)))
    rank = lambda i: (rows[i][0] is None, rows[i][0] or 0, i)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    close = [(i, j) for i in range(len(rows)) for j in range(i) if (simhash.fingerprint(rows[i][1]) ^ simhash.fingerprint(rows[j][1])).bit_count() <= 3]
    for i, j in close + brute_links(rows):
        a, b = sorted((top(i), top(j)), key=rank)
        parent[b] = a
    return sorted({top(i) for i in range(len(rows))})


def test_near_copies_go_and_others_stay(spark):
    rows = [r for r in near_rows() if r[0] is not None]
    want = [rows[i][0] for i in brute_kept(rows)]
    kept = corpus_pipeline.unlike(spark, frame(spark, rows), None)
    assert kept.columns == ["doc_id", "text", "kept", "digest", "fp"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert len(want) < simhash.drop_near_copies(frame(spark, rows)).count()


@pytest.mark.parametrize("block", [256, 6])
def test_groups_that_share_a_passage(spark, monkeypatch, block):
    """Texts share most of a passage without being near copies; near copies among them are found, all in small groups and most in large ones."""
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, rows = words(120), []
    for i in range(60):
        own = passage + words(50)
        rows.append((2 * i, " ".join(own)))
        if i % 3 == 0:
            rows.append((2 * i + 1, " ".join([*own[:-7], *words(7)])))
    assert len(brute_links(rows)) == 20
    kept = {r.doc_id for r in near.drop_near_copies(frame(spark, rows)).collect()}
    missed = kept - {rows[i][0] for i in brute_kept(rows)}
    assert len(kept) - len(missed) == 60 and len(missed) <= (0 if block == 256 else 4)


def of_passages(rng, passages, each, tail):
    """Rows that share most of a passage: per passage, texts with ends of their own, and a near copy of every third of them."""
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for _ in range(passages):
        passage = words(120)
        for i in range(each):
            own = passage + words(tail)
            rows.append((len(rows), " ".join(own)))
            if i % 3 == 0:
                rows.append((len(rows), " ".join([*own[:-5], *words(5)])))
    return rows


@pytest.mark.parametrize("block, chars", [(20, 1 << 24), (256, 20_000)])
def test_large_groups_are_compared_whole(spark, monkeypatch, block, chars):
    """All texts share one fingerprint only; neither their number nor their code points lose a link."""
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "BLOCK_CHARS", chars)
    texts = spark.createDataFrame(of_passages(random.Random(5), 1, 90, 45), "number long, text string")
    found = near.prints(texts).withColumn("keys", F.expr("array(7L)")).localCheckpoint()
    roots = near.classes(found, texts).groupBy("root").count().collect()
    assert [r["count"] for r in roots] == [2] * 30


def test_each_pair_of_different_roots_meets_once(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 4)
    monkeypatch.setattr(near, "BLOCK_CHARS", 50)
    rows = [(k, n, n, 9 + n % 5, n % roots if n % 2 else 0, True) for k, roots, many in [(1, 7, 60), (2, 3, 9), (3, 2, 100)] for n in range(many)]
    rows += [(4, n, n, 1, n % 2, False) for n in range(3)]
    members = spark.createDataFrame(rows, "key long, number long, fp long, chars int, root long, large boolean")
    groups = {}
    for r in near.dealt(members).collect():
        assert r.block in (r.low, r.high)
        groups.setdefault((r.key, r.low, r.high), []).append(r)
    met = {}
    for (_, low, high), group in groups.items():
        for one in group:
            for two in group:
                if one.number < two.number and one.root != two.root and (low == high or one.block != two.block):
                    met[one.key, one.number, two.number] = met.get((one.key, one.number, two.number), 0) + 1
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[4] != b[4]}
    assert set(met) == want and set(met.values()) == {1}
    assert max(map(len, groups.values())) < 40


@pytest.mark.parametrize("columns", [1 << 13, 5])
def test_links_of_two_sides_and_of_one(monkeypatch, columns):
    monkeypatch.setattr(near, "COLUMNS", columns)
    texts = [t for _, t in of_passages(random.Random(8), 2, 12, 45)] + ["one", "one two", "a b c d e f"]
    group = [(i, i // 2 if i < 8 else i, near._hashed(t)) for i, t in enumerate(texts)]
    close = [(i, j) for j, i in brute_links(list(enumerate(texts))) if group[i][1] != group[j][1]]

    def classes(pairs):
        top = {x[1]: x[1] for x in group}
        for i, j in pairs:
            old, new = top[group[i][1]], top[group[j][1]]
            top = {k: new if v == old else v for k, v in top.items()}
        return sorted(sorted(k for k in top if top[k] == v) for v in set(top.values()))

    assert len(close) >= 4 and classes(near._links(group, group)) == classes(close)
    left, right = group[::2], group[1::2]
    across = [(i, j) for i, j in close if i % 2 != j % 2]
    assert across and classes(near._links(left, right)) == classes(across)
    assert near._links(left, []) == near._links([], right) == []


def test_candidates_are_verified(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    half = base[:130] + [f"x{i}" for i in range(70)]
    assert near.similarity(" ".join(base), " ".join(half)) < 0.8
    pairs = spark.createDataFrame([(1, 2, 7, 8), (1, 3, 7, 9)], "a long, b long, u long, v long")
    rows = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(half)), (3, " ".join(base[:195]))], "number long, text string")
    assert [(r.u, r.v) for r in near.verified(pairs, rows).collect()] == [(7, 9)]


def test_large_groups_and_odd_rows(spark):
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(words[:149] + [f"v{i}"])) for i in range(1, 400)]
    rows += [(None, None), (None, "q r s"), (500, ""), (501, " "), (600, "a b c d e f"), (600, "a b c d e f")]
    kept = near.drop_near_copies(frame(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "500", "600", "None"])
    assert near.drop_near_copies(frame(spark, rows).limit(0)).count() == 0
