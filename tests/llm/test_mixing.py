"""Mixing: targets, shares at the cut, and repeats."""

import re

import pytest

from tarnwork.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target int, row int, part int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + count(text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= set(over)
    return sizes, target


ROWS = [(i, "w " * (1 + i * 7 % 50), f"s{i % 9}") for i in range(500)] + [(1000 + i, "w\x0bx" * 3, None) for i in range(20)] + [(2000, None, "s1"), (2001, "", "s2"), (2002, " \t", "empty"), (None, "a b", "s3"), (5, "w " * 9, "s5"), (5, "w " * 9, "s5"), (3000, "big " * 5000, "s0")]
LOPSIDED = [(i, "w " * 10, "big") for i in range(300)] + [(500 + i, "w " * 10, s) for i, s in enumerate(["a", "b", "é", "Z", ""])]


@pytest.mark.parametrize("rows", [ROWS, LOPSIDED, [(1, "a b c", "s")]])
def test_shares(spark, rows):
    sizes, target = plain_targets(rows)
    got = mixing.mix_sizes(frame(spark, rows)).collect()
    again = mixing.mix_sizes(frame(spark, rows).repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken, r.target)
    assert sorted(map(key, got)) == sorted(map(key, again))
    source = {}
    for i, text, s in rows:
        source.setdefault((i, count(text)), []).append(s)
    taken = {}
    for r in got:
        s = source[r.doc_id, r.size].pop()
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) < 1.001 for s in sizes)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))


def test_mix_returns_documents(spark):
    rows = [(i, "w " * 20, f"s{i % 4}") for i in range(400)]
    out = mixing.mix(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    per = {r.source: r["count"] * 20 for r in out.groupBy("source").count().collect()}
    _, target = plain_targets(rows)
    assert all(abs(per[s] - target[s]) <= 10 for s in target)
    assert max(r["count"] for r in out.groupBy("doc_id").count().collect()) <= 2


def test_service_order_holds_shares(spark):
    """At any point of the mix, every source has had its share, within a document."""
    rows = [(i, "w " * 10, f"s{i % 3}") for i in range(300)]
    order = [r.source for r in mixing.mix(frame(spark, rows).coalesce(1)).collect()]
    half = order[: len(order) // 2]
    assert all(abs(half.count(s) - order.count(s) / 2) <= 2 for s in set(order))


def test_empty(spark):
    assert mixing.mix_sizes(frame(spark, [])).count() == 0
