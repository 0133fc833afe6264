"""Role repair against exhaustive search, and the rendered form."""

import itertools

import pytest

from tarnwork.llm import chat


def brute(roles):
    """Least cost by trying every action sequence (Dijkstra over states is what is tested, so enumerate)."""
    best = [float("inf")]

    def go(i, state, cost, inserts):
        if cost >= best[0]:
            return
        if i == len(roles):
            if state in (chat.FINAL,) or (state == 0 and not roles):
                best[0] = cost
            elif inserts < 4:
                for role in chat.NEXT[state]:
                    go(i, role + 1, cost + chat.INSERT, inserts + 1)
            return
        for role in chat.NEXT[state]:
            go(i + 1, role + 1, cost + chat.RELABEL * (roles[i] != role), 0)
            if inserts < 4:
                go(i, role + 1, cost + chat.INSERT, inserts + 1)
        if state:
            go(i + 1, state, cost + chat.MERGE + chat.RELABEL * (roles[i] != state - 1), 0)

    go(0, 0, 0, 0)
    return best[0]


def least(roles):
    cost, _ = chat.forward(roles, 0)
    return min(c + chat.closing(s) for s, c in enumerate(cost) if s)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_least_cost(n):
    for roles in itertools.product(range(4), repeat=n):
        assert least(list(roles)) == brute(list(roles)), roles


def parse(text):
    parts = [p.split("\n", 1) for p in text.split(chat.OPEN)[1:]]
    return [(role, body.removesuffix(chat.CLOSE)) for role, body in parts]


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return len(roles) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


@pytest.mark.parametrize("segment", [2, 3, 4096])
def test_query(spark, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    rows = [
        (1, 0, "user", "a", "z"), (1, 1, "assistant", "b", "z"),
        (2, 0, "assistant", "x", "z"), (2, 1, "assistant", "y", "z"), (2, 2, "User ", None, "z"), (2, 3, None, "", "z"), (2, 4, "system", "s", "z"),
        (None, None, "user", "q", "z"), (3, 0, "user", "a", "z"), (3, 0, "user", "a", "z"), (4, 0, "system", "only", "z"),
        *[(5, i, ("user", "assistant", "tool")[i % 3], f"t{i}", "z") for i in range(17)],
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {}
    for r in sorted(chat.formatted(turns).collect(), key=lambda r: r.segment):
        text, cost = got.get(r.conv_id, ("", 0))
        got[r.conv_id] = text + r.rendered, cost + r.cost
    assert len(got) == 6
    for conv, (text, cost) in got.items():
        own = sorted([x[:4] for x in rows if x[0] == conv], key=lambda x: x[1] or 0)
        assert cost == least([chat.role_number(x[2]) for x in own])
        assert legal([role for role, _ in parse(text)])
        assert [x[3] for x in own if x[3]] == [p for _, body in parse(text) for p in body.split("\n") if p]
    assert got[1][0] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"


def test_no_turn_number_and_no_order_is_one_task(spark, monkeypatch):
    """A conversation of null and equal turn numbers and repeated rows is cut like any other."""
    monkeypatch.setattr(chat, "SEGMENT", 50)
    monkeypatch.setattr(chat, "BYTES", 400)
    rows = [(7, None, "user", f"n{i:04}") for i in range(300)] + [(7, 3, "assistant", "same")] * 300 + [(8, 0, "user", "long " * 200), (8, 1, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = sorted(chat.formatted(turns).collect(), key=lambda r: r.segment)
    own = [r for r in got if r.conv_id == 7]
    assert max(r.n_turns for r in got) <= 50 and sum(r.n_turns for r in own) == 600 and len(own) >= 12
    assert sum(r.cost for r in own) == least([2] * 300 + [1] * 300)
    text = parse("".join(r.rendered for r in own))
    assert legal([role for role, _ in text])
    assert [p for _, body in text for p in body.split("\n") if p] == ["same"] * 300 + [f"n{i:04}" for i in range(300)]


def test_extra_columns_and_text_ids(spark):
    turns = spark.createDataFrame([("a", 0, "user", "x", 1, 2, "y"), ("a", 1, "bot", None, 1, 2, "y")], "conv_id string, turn int, role string, text string, conv int, uid int, costs string")
    (row,) = chat.formatted(turns).collect()
    assert (row.conv_id, row.cost, row.rendered) == ("a", 0, "<|im_start|>user\nx<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted(turns).count() == 0
