"""Scopes, graph, PageRank, rankers, fusion and the engine."""

import itertools
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tarnwork.operators import fusion, graph, rankers, scopes, vectors
from tarnwork.operators.ranking import ranked
from tarnwork.plans.retrieval import RetrievalEngine
from tarnwork.sources import readers


def test_offsets_are_bytes():
    text = "# é\n@dec\ndef f():\n    return 'ü'\n\nx = 1\n"
    (row,) = scopes.scopes("a.py", text, "python")
    raw = text.encode()[row["byte_start"] : row["byte_end"]].decode()
    assert raw == row["source"] == "@dec\ndef f():\n    return 'ü'\n\n"
    assert (row["line_start"], row["line_end"], row["start_col"]) == (2, 5, 0)


def test_braces_in_strings_and_comments():
    text = 'fn f() {\n  let a = "}"; // }\n  /* } */\n}\nstruct U;\nimpl<T> Show for fmt::U { }\n'
    found = scopes.scopes("a.rs", text, "rust")
    assert [(r["kind"], r["name"], r["line_start"], r["line_end"]) for r in found] == [("function", "f", 1, 4), ("struct", "U", 5, 5), ("impl", "fmt::U", 6, 6)]


def test_calls_and_definitions():
    assert scopes.call_sites("def run():\n    a::b::c (1)\n    go()") == ["a", "a::b", "a::b::c", "b", "b::c", "c", "go"]
    assert "run" in scopes.call_sites("x.run()") and "A" in scopes.call_sites("A::new()")


def test_blocks_without_semicolons():
    ends = lambda text: [(r["name"], r["line_start"], r["line_end"]) for r in scopes.scopes("a.js", text, "javascript")]
    assert ends("function outer() {\n  const f = x => x + 1\n}\nfunction g() {\n}\n") == [("outer", 1, 3), ("f", 2, 5), ("g", 4, 5)]
    assert ends("function cut() {\n  if (x) {\n") == []
    assert [r["name"] for r in scopes.scopes("a.rs", "mod a }\nfn f() { }\n", "rust")] == ["a", "f"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["fn f", "mod a", "class A", "def g", "function h", "const k = x =>", "{", "}", ";", "(", ")", ":", "'", '"', "//", "/*", "*/", "\n", "    ", "\\", "é", "@d", "impl T"]), max_size=30), st.sampled_from(["rust", "python", "javascript", "unknown"]))
def test_scopes_never_raise(parts, lang):
    text = " ".join(parts)
    for row in scopes.scopes("x", text, lang):
        assert text.encode()[row["byte_start"] : row["byte_end"]].decode() == row["source"]
    scopes.imports(text)


def test_fields():
    assert scopes.struct_fields("pub struct P {\n    pub a: u8,\n    b: Vec<u8>,\n    pub(crate) c: u8,\n}\n") == ["a", "b"]
    assert scopes.struct_fields("struct P { a: u8 }") == []


FILES = [
    ("auth.py", "def login(user):\n    check(user)\n    return token(user)\n\n\ndef check(user):\n    return user\n\n\ndef token(user):\n    return sign(user)\n\n\ndef sign(user):\n    return user\n\n\ndef unrelated():\n    return 1\n"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "file_path string, source string")


def test_callees_outrank_the_unrelated(spark, files):
    nodes, edges = graph.scope_graph(scopes.parse_files(files), scopes.parse_imports(files))
    focus = nodes.where("name = 'login'").select("key", F.lit(1.0).alias("mass"))
    by_joins = {r.key: r.rank for r in graph.personalized_pagerank(nodes, edges, focus, iterations=6, small_graph=0).collect()}
    in_memory = {r.key: r.rank for r in graph.personalized_pagerank(nodes, edges, focus, iterations=6).collect()}
    assert by_joins == pytest.approx(in_memory) and sum(by_joins.values()) == pytest.approx(1)
    rank = {k.split(":")[-2]: v for k, v in in_memory.items()}
    assert rank["check"] > rank["unrelated"] and rank["sign"] > rank["unrelated"]


def test_pagerank_of_nothing(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "key string")
    edges = spark.createDataFrame([], "src_key string, dst_key string, kind string, weight double")
    assert {r.key: r.rank for r in graph.personalized_pagerank(nodes, edges).collect()} == pytest.approx({"a": 0.5, "b": 0.5})


def test_cosine_prefers_paraphrase(spark):
    docs = spark.createDataFrame([(1, "verify user password hash"), (2, "render the blue button"), (3, "")], "id int, text string")
    counts = vectors.counted(docs.union(spark.createDataFrame([(4, None)], "id int, text string")), "id", "text")
    idf = vectors.fit_idf(docs, "id", "text")
    lengths = vectors.norms(vectors.weights(counts, "id", idf), "id")
    found = {r.id: r.similarity for r in vectors.similarities("user password check", counts, lengths, "id", idf).collect()}
    assert found[1] > found.get(2, 0) and not found.keys() & {3, 4}
    assert vectors.similarities("", counts, lengths, "id", idf).count() == 0


def test_ranks_with_any_column_names(spark):
    rows = spark.createDataFrame([(2, "b", 7), (1, "a", 8)], "at int, part string, offset int")
    assert [(r.at, r.part, r.offset, r["rank"]) for r in ranked(rows, "at").orderBy("rank").collect()] == [(1, "a", 8, 1), (2, "b", 7, 2)]


def test_ranks_of_many_partitions(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 100).alias("v")).repartition(7)
    got = {r.id: r.rank for r in ranked(rows, F.desc("v"), "id").collect()}
    order = sorted(range(1000), key=lambda i: (-(i * 7919 % 100), i))
    assert got == {i: k + 1 for k, i in enumerate(order)}
    assert [(r.id, r.rank) for r in ranked(rows, F.desc("v"), "id", limit=3).orderBy("rank").collect()] == [(i, k + 1) for k, i in enumerate(order[:3])]
    assert ranked(rows.limit(0), "v").count() == 0


def test_query_tokens():
    assert rankers.query_tokens("Get the a_b x, É get!") == ["get", "the", "a_b", "get"]


def brute_clusters(hits, options):
    def near(a, b):
        if a[0] == b[0]:
            return True
        spans = a[2] - a[1] + 1, b[2] - b[1] + 1
        return a[3] == b[3] and max(spans) <= options.window + options.slack and max(a[2], b[2]) - min(a[1], b[1]) + 1 <= options.window + max(spans)

    left, out = set(range(len(hits))), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            i = todo.pop()
            group.add(i)
            more = {j for j in left if near(hits[i], hits[j])}
            left -= more
            todo += more
        out.append(frozenset(hits[i] for i in group))
    return set(out)


HITS = "ranker string, weight double, rank int, confidence double, id string, file_path string, line_start int, line_end int, content string"


@pytest.mark.parametrize("seed", range(4))
def test_clusters(spark, seed):
    rng = random.Random(seed)
    files = "f" if seed < 2 else "fgh"
    hits = sorted({(str(rng.randrange(60 + 60 * seed)), s, s + rng.randrange(24), rng.choice(files)) for s in (rng.randrange(1, 900) for _ in range(60))})
    rows = spark.createDataFrame([("v", 1.0, 1, 0.5, i, f, a, b, "") for i, a, b, f in hits], HITS)
    got = {}
    for r in fusion.clustered(rows).collect():
        got.setdefault(r.cluster, set()).add((r.id, r.line_start, r.line_end, r.file_path))
    assert set(map(frozenset, got.values())) == brute_clusters(hits, fusion.Fusion())


def test_one_id_in_two_files_is_one_candidate(spark):
    rows = spark.createDataFrame([("vector", 1.0, 1, 0.5, "a", "f", 3, 5, "A"), ("ast", 0.9, 1, 0.4, "a", "g", 90, 95, "B"), ("ast", 0.9, 2, 0.4, "", "g", 300, 400, "C"), ("ast", 0.9, 3, 0.4, "", "g", 300, 400, "C")], HITS)
    out = fusion.blend(rows).orderBy("position").collect()
    assert [(r.id, r.file_path, r.line_start, r.line_end) for r in out] == [("a", "f", 3, 95), ("", "g", 300, 400), ("", "g", 300, 400)]
    assert out[0].score == pytest.approx(1.9 / 61) and out[0].content == "A\nB"


def test_a_list_fills_ranks_and_rankers(spark):
    items = spark.createDataFrame([(0, "", 1), (7, "x", 2), (None, None, 3)], "rank int, ranker string, place int")
    got = fusion.ranked_list(items, "ast", 2).collect()
    assert [(r["rank"], r.ranker, r.weight) for r in got] == [(1, "ast", 2.0), (7, "x", 2.0), (3, "ast", 2.0)]


def test_blend(spark):
    schema = "ranker string, weight double, rank int, confidence double, id string, file_path string, line_start int, line_end int, content string"
    rows = [
        ("vector", 1.0, 1, 0.5, "a", "f", 3, 5, "A"), ("ast", 1.0, 2, 0.4, "a", "f", 3, 5, "A"), ("vector", 1.0, 2, 0.3, "b", "f", 8, 9, "B"),
        ("regex", 1.0, 8, 0.99, "c", "g", 1, 2, "C"), ("vector", 1.0, 3, 0.1, "d", "f", 100, 160, "D"), ("vector", 1.0, 0, -3.0, "e", "h", 0, 0, "E"),
    ]
    sources = spark.createDataFrame([("f", "\n".join(f"l{i}" for i in range(1, 31)) + "\n")], "file_path string, source string")
    out = fusion.blend(spark.createDataFrame(rows, schema), sources).orderBy("position").collect()
    assert [r.id for r in out] == ["c", "f:3-9", "e", "d"]
    assert out[0].override_floated and out[0].score == pytest.approx(1.99 + 1000.99)
    assert out[1].content == "\n".join(f"l{i}" for i in range(3, 10)) and out[1].members == ["a", "b"]
    assert out[1].score == pytest.approx(1 / 61 + 1 / 62) and out[3].content == "D"
    assert fusion.context(fusion.blend(spark.createDataFrame(rows, schema), sources, top_k=1)).first().context == "# g c:1-2\nC\n"


def test_engine(spark, files):
    engine = RetrievalEngine().index(files)
    out = engine.query("login token", 4)
    top = out.blended.orderBy("position").collect()
    assert len(top) <= 4 and "login" in top[0].content and out.n_nodes == 6
    assert "def login" in out.context().first().context
    # With a short vector list, neighbours that PageRank finds are added.
    few = RetrievalEngine(vector_limit=1).index(files).query("login", 4)
    assert few.vector.count() == 1 and few.blended.count() >= 1


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def f():\n    pass\n")
    assert [r.source for r in readers.source_tree(spark, str(tmp_path), "*.py").collect()] == ["def f():\n    pass\n"]
    assert [r.name for r in readers.payload_files(spark, str(tmp_path)).collect()] == ["a.py"]
    readers.write(spark.range(3).withColumn("k", F.lit("x")), str(tmp_path / "out"), "json", ("k",))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_containment(spark):
    rows = [(k, i, a, b) for k in "xy" for i, (a, b) in enumerate([(1, 9), (2, 5), (2, 5), (3, 4), (1, 9)])]
    frame = spark.createDataFrame(rows, "file_path string, id int, line_start int, line_end int")
    got = {(r.file_path, r.owner_id, r.child_id) for r in graph.containment(frame, frame, "file_path").collect()}
    expected = {(a[0], a[1], b[1]) for a, b in itertools.product(rows, rows) if a[0] == b[0] and a[1] != b[1] and b[2] >= a[2] and b[3] <= a[3] and (b[2] > a[2] or b[3] < a[3])}
    assert got == expected
