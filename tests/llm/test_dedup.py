"""Exact and near deduplication against brute force."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tarnwork.llm import exact_dedup, mixing, near, simhash
from tarnwork.llm.components import components

SCHEMA = "doc_id long, text string, kept string, digest int, fp string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)


def mixing_all(docs):
    return mixing.mix(docs.withColumn("source", F.lit("s"))).drop("source")


ROWS = [
    (5, "a b\tc"), (2, "abc"), (9, " a  b c "), (3, None), (4, ""), (6, " \n"), (7, "zz"), (7, "zz"), (None, "q"), (8, "q "), (None, "only"), (10, "Ünï\x0bcode"), (11, "Ünïcode"), (12, "x" * 300_000), (13, "x" * 300_000 + " "), (14, "a bc"),
]


def squeeze(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(squeeze(t), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        own = sorted(groups[squeeze(t)])
        out.append((str(i), str(None if own[0][1] else own[0][2]), len(own), hashlib.sha256(squeeze(t).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, weak):
    digest = (lambda c: F.substring(exact_dedup.sha256(c), 1, 1)) if weak else exact_dedup.sha256
    rows = ROWS + [(100 + i, f"t {i % 40}") for i in range(200)] * (1 if weak else 3)
    got = exact_dedup.exact_groups(frame(spark, rows), digest).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute(rows)
    assert sum(r.kept for r in got) == len({squeeze(t) for _, t in rows})


def test_weak_digest_is_verified(spark):
    index = exact_dedup.MergeIndex(spark, digest=lambda c: F.lit(b"1"))
    docs = frame(spark, [(1, "a"), (2, "b")]).select("doc_id", "text")
    index.add(docs)
    index.add(frame(spark, [(0, "longer text")]).select("doc_id", "text"))
    top = index.compact()
    assert top.first().group_size == 3 and top.first().doc_id == 0
    assert exact_dedup.differing(docs, top, index.digest).count() == 1


def test_index_of_batches(spark):
    index = exact_dedup.MergeIndex(spark)
    index.add(frame(spark, [(1, "a b"), (2, "c"), (3, None)]))
    index.add(frame(spark, [(4, "a  b c")]))
    assert {r.doc_id for r in index.find(" ab").collect()} == {1} and index.find("zz").count() == 0
    batch = frame(spark, [(10, "ab"), (11, "new"), (12, " "), (13, "abc")])
    assert {(r.doc_id, r.keep_id) for r in index.hits(batch).collect()} == {(10, 1), (12, 3), (13, 4)}
    assert index.twice().count() == 0
    index.add(frame(spark, [(0, "c")]))
    assert index.twice().count() == 1
    assert {r.doc_id: r.group_size for r in index.compact().collect()} == {1: 1, 0: 2, 3: 1, 4: 1}


def test_drop_copies(spark):
    got = exact_dedup.drop_copies(frame(spark, ROWS))
    assert got.columns == ["doc_id", "text", "kept", "digest", "fp"]
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(map(str, [9, 6, 7, 8, None, 10, 13, 14]))


CLASHES = "doc_id long, text string, _row int, number int, row string, digest string, filter int, `a.b` int"


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, simhash.drop_near_copies, near.drop_near_copies, mixing_all])
def test_no_column_is_lost(spark, drop):
    rows = [(i, t, i, 5, "r", "d", 3, 4) for i, t in [(1, "one two three"), (2, "four five six seven"), (2, "four five six seven"), (None, None)]]
    docs = spark.createDataFrame(rows, CLASHES)
    out = drop(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} <= set(rows) and out.count() >= 2


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(none).count() == 0 and simhash.grouped(none).count() == 0


def plain_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def brute_components(rows):
    prints = [plain_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted((str(doc), f"{p:016x}", str(least.get(top(i)))) for i, ((doc, _), p) in enumerate(zip(rows, prints)))


def near_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 7)))
    rows, n = [(None, "lone words here"), (None, None), (900, ""), (901, " "), (902, "One"), (903, "one two"), (904, "É x y"), (905, "w " * 70_000)], 0
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(3, 400))]
        for _ in range(rng.randrange(1, 7)):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = word()
            rows.append((n, " ".join(own)))
            n += 1
    return rows + rows[10:14]


def test_near(spark):
    rows = near_rows()
    got = simhash.grouped(frame(spark, rows)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("h"), "component_id").collect()
    assert sorted((str(r.doc_id), r.h, str(r.component_id)) for r in got) == brute_components(rows)
    kept = simhash.drop_near_copies(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "kept", "digest", "fp"]
    assert kept.count() == len({c if c != "None" else d + h for d, h, c in brute_components(rows)})


def test_links_at_every_distance(spark):
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for d in range(1, 6):
            q = p
            for b in rng.sample(range(64), d):
                q ^= 1 << b
            prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {frozenset((r.u, r.v)) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    assert found == {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(-40, 0)] + [(100, 100 + i) for i in range(1, 300)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else top(parent[x])

    for u, v in edges:
        if u != v:
            a, b = sorted((top(u), top(v)))
            parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in parent}
