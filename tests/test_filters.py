"""Text filters: code, logs, JSON and YAML, classifier, pipeline and streams."""

import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tarnwork.functions import classify, jsonyaml
from tarnwork.operators import code, logs
from tarnwork.plans import pipeline
from tarnwork.streaming import filters


def apply(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string")
    return [r.out for r in rows.select("i", f(F.col("body")).alias("out")).orderBy("i").collect()]


CODE = [
    ('url = "http://a/b"  // gone\n', 'url = "http://a/b"\n'),
    ("s = '# kept'  # gone", "s = '# kept'"),
    ("def f():\n    return 1\n", "def f():\n    return 1\n"),
    ("#!/bin/sh\n# note\necho\n", "#!/bin/sh\n\necho\n"),
    ("#[derive(Debug)]\nstruct A;\n", "#[derive(Debug)]\nstruct A;\n"),
    ("a /* x\ny */ b\n", "a\n b\n"),
    ("fn f<'a>(x: &'a str) {} // c\n", "fn f<'a>(x: &'a str) {}\n"),
    ('x = """# in\n// text""" # out\n', 'x = """# in\n// text"""\n'),
    ('let r = r#"a "# b // no"#; // yes', 'let r = r#"a "# b'),
    ('let r = r##"a "# // no"##; // yes', 'let r = r##"a "# // no"##;'),
    ("a\r\n\r\n\r\nb  \t\n\n", "a\n\nb\n"),
    ("\n\n\na", "a"),
    ("x = 'it\\'s' # c", "x = 'it\\'s'"),
    ("/*/ still */ b", " b"),
    ("", ""),
    (None, None),
]


def test_code(spark):
    texts, expected = zip(*CODE)
    for text, got, e in zip(texts, apply(spark, code.clean_code, texts), expected):
        assert got == e, text


def test_long_tokens_need_no_stack(spark):
    text = '"' + "x\\\"" * 100_000 + '" # c\n/* ' + "y " * 100_000 + "*/ z"
    assert apply(spark, code.clean_code, [text])[0].endswith('"\n z')


def test_uncollapsed_lines(spark):
    f = lambda c: code.clean_code(c, code.CodeOptions(collapse_blank_lines=False))
    assert apply(spark, f, ["\na\n\n\nb\n", "a\n  "]) == ["a\n\n\nb\n", "a\n\n"]


def test_logs(spark):
    run = "".join(f"Compiling c{i} v1\n" for i in range(5))
    texts = [
        "[1/9] build\n[2/9] build\nerror: x\n", "0%\r50%\r100% done\n", "\x1b[31mred\x1b[0m\n", run + "ok\n", "Compiling a\nCompiling b\n", "a\na\n\na\nb",
        "progress: 3\n|/-\\\n3 / 4\nkeep  this\tline\n", "foo\r\n", "Downloading x\nz\n", "", None,
        "a \x1b(B hello \x07 b", "a\x1b(Bb \x1bM c\x07", "\x1b]0;title\x07x\n\x1b]8;;u\x1b\\y\n", "\x01one\n\x01two\n\x01three\n\x01four\n", "cat\nCompiling a\nodd\n",
    ]
    expected = ["build\nerror: x\n", "done\n", "red\n", "Compiling c0 v1\ncompiled 5 crates (c0 … c4)\nCompiling c4 v1\nok\n", "Compiling a\nCompiling b\n", "a\nb", "keep this line\n", "", "z\n", "", None]
    expected += ["a hello \x07 b", "ab \x1bM c\x07", "x\ny\n", "\x01one\n\x01two\n\x01three\n\x01four\n", "cat\nCompiling a\nodd\n"]
    assert apply(spark, logs.clean_log, texts) == expected


def test_long_log(spark):
    text = "".join(f"Compiling c{i}\n" for i in range(50_000))
    assert apply(spark, logs.clean_log, [text]) == ["Compiling c0\ncompiled 50000 crates (c0 … c49999)\nCompiling c49999\n"]


def test_kinds(spark):
    texts = ['{"a": 1}', "[1, 2]", "  [true]\n", "fn main() {}", "[1/3] a\r", "Compiling a\nCompiling b\n[1/2] x\nETA 3", None]
    assert apply(spark, classify.payload_kind, texts)[:6] == ["json", "code", "json", "code", "log", "log"]
    rows = spark.createDataFrame([("a.RS", ""), ("x", "def f():\nclass A:"), ("x", "fn a\ndef b"), ("x", "export function a"), ("x", "")], "p string, s string")
    assert [r[0] for r in rows.select(classify.language(F.col("p"), F.col("s"))).collect()] == ["rust", "python", "rust", "javascript", "unknown"]


JSON = st.recursive(
    st.none() | st.booleans() | st.integers() | st.text(alphabet=st.characters(codec="utf-8", exclude_characters="", exclude_categories=["Cs", "Zl", "Zp"]), max_size=8),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet="ab:- \"'#", max_size=4), x, max_size=3),
    max_leaves=8,
)


@settings(max_examples=400, deadline=None)
@given(JSON)
def test_yaml_inverts(value):
    text = json.dumps(value, ensure_ascii=False)
    assert json.loads(jsonyaml.from_yaml(jsonyaml.to_yaml(text))) == value


@pytest.mark.parametrize(
    ("text", "yaml"),
    [
        ('{"a": 1.50, "a": 1e2}', "a: 1.50\na: 1e2"), ('{"k": {"x": [1, {"y": []}]}}\n', "k:\n  x:\n    - 1\n    - \"y\": []\n"), ('{"v": "007", "w": "1.5", "t": "Yes"}', 'v: 007\nw: "1.5"\nt: "Yes"'),
        ("not json", "not json"), ("[1,]", "[1,]"), ('"\\ud83d\\ude00"', '"\\ud83d\\ude00"'), ("NaN", "NaN"), ("[[1]]", "- \n  - 1"), ("[]", "[]"),
    ],
)
def test_yaml_form(text, yaml):
    assert jsonyaml.to_yaml(text) == yaml


def test_json_columns(spark):
    assert apply(spark, jsonyaml.json_to_yaml, ['{"a": 1}', "x", None]) == ["a: 1", "x", None]
    assert apply(spark, lambda c: jsonyaml.flat_object_yaml(c, ("k", "m")), ['{"k": 1, "m": -2.50}\n', '{"k": 1}', None]) == ["k: 1\nm: -2.50\n", None, None]
    texts = ['{"a" 1}', "3", "   {x}", ' {"a": 1} x', '["NaN", NaN]', '"\\ud83d"', "", None, "[" * 100_000]
    error = apply(spark, jsonyaml.json_error, texts)
    assert [(e.ok, e.position) for e in error] == [(False, 5), (True, None), (False, 4), (False, 10), (False, 8), (False, 1), (False, 0), (None, None), (False, None)]
    assert error[2].message == "Expecting property name enclosed in double quotes" and error[3].message == "Extra data"


def test_deep_texts_are_left():
    deep = "[" * 100_000 + "]" * 100_000
    assert jsonyaml.to_yaml(deep) == deep
    assert jsonyaml.from_yaml("\n".join("  " * i + "a:" for i in range(3000))) is None


def test_pipeline(spark):
    rows = spark.createDataFrame([("a", "x = 1  # c\n"), ("b", None), ("c", '{"k": "v"}')], "name string, body string")
    chain = pipeline.baseline_pipeline()
    assert (len(chain), chain.is_empty, repr(chain)) == (3, False, "Pipeline(code_cleaner, log_cleaner, data_converter)")
    out = {r.name: r for r in chain.execute_traced(rows).collect()}
    assert (out["a"].output, out["a"].bytes_saved, [s.stage for s in out["a"].stages]) == ("x = 1\n", 5, chain.stage_names)
    assert out["b"].output is None and out["c"].output == "k: v"
    assert pipeline.Pipeline().execute(rows).where("name = 'a'").first().output == "x = 1  # c\n"
    kinds = {r.name: (r.kind, r.output) for r in pipeline.routed(rows.where("body IS NOT NULL")).collect()}
    assert kinds == {"a": ("code", "x = 1\n"), "c": ("json", "k: v")}


def test_timed_stages(spark):
    rows = spark.createDataFrame([("a", "x = 1  # c\n"), ("b", "y\n")], "name string, body string")
    out, report = pipeline.baseline_pipeline().execute_timed(rows)
    assert {r.name: r.output for r in out.collect()} == {"a": "x = 1\n", "b": "y\n"}
    got = report.orderBy("place").collect()
    assert [(r.stage, r.input_bytes, r.output_bytes) for r in got] == [("code_cleaner", 13, 8), ("log_cleaner", 8, 8), ("data_converter", 8, 8)] and all(r.elapsed_us > 0 for r in got)


def test_token_counter(spark, tmp_path):
    import base64

    pytest.importorskip("tiktoken")
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256)) + f"{base64.b64encode(b'ab').decode()} 256\n")
    assert apply(spark, pipeline.token_counter(str(path)), ["abc", "", None]) == [2, 0, None]


def test_telemetry(spark, tmp_path):
    import base64

    pytest.importorskip("tiktoken")
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256)))
    rows = spark.createDataFrame([("abcd", "ab"), ("", "")], "body string, output string")
    context = spark.createDataFrame([("xyz",)], "context string")
    got = {r.metric: r.value for r in pipeline.telemetry(rows, pipeline.token_counter(str(path)), context=context, elapsed_ms=5).collect()}
    assert got == {"initial_tokens": 4, "final_tokens": 2, "tokens_saved": 2, "saved_pct": 50, "context_tokens": 3, "elapsed_ms": 5}


def test_stream(spark, tmp_path):
    rows = [("a", "x = 1  # c\n"), ("b", '{"k": "v"}')]
    spark.createDataFrame(rows, filters.PAYLOAD).write.parquet(str(tmp_path / "in"))
    stream = filters.clean_stream(filters.read_payloads(spark, str(tmp_path / "in")))
    filters.start(stream, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination(120)
    assert {r.name: r.output for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": "x = 1\n", "b": "k: v"}
