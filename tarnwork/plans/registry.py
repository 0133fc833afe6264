"""Registered queries of the core engine and their DuckDB equivalents.

No table holds source code, build logs or nested JSON, so such texts are composed of table columns by
the same expression on both sides; small programs stand as literal rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tarnwork.functions import classify, jsonyaml, text as tx
from tarnwork.operators import code, fusion, graph, logs, rankers, scopes, vectors
from tarnwork.plans import demo, pipeline
from tarnwork.plans.retrieval import RetrievalEngine
from tarnwork.sources.readers import spread, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A query as a user would type it.
SEARCH = "stupid question about the nation of inflation"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _texts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """doc_id, text and other columns of documents."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *more))


# DuckDB fragments. RE2's \s is ASCII, and so is the white space in the tables.
_TRIM = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_JSONISH = "(({0} LIKE '{{%' AND {0} LIKE '%}}') OR ({0} LIKE '[%' AND {0} LIKE '%]')) AND (contains({0}, ':') OR contains({0}, 'true') OR contains({0}, 'null'))"


def _kind_sql(t: str, key: str, column: str) -> str:
    return f"""
WITH h AS (
  SELECT {key} AS id, {column} AS t, {_TRIM.format(column)} AS b,
         list_transform(list_slice(string_split(regexp_replace({column}, '\\n$', ''), chr(10)), 1, 80), lambda x: {_TRIM.format('x')}) AS head
  FROM {t}
), s AS (
  SELECT id, b, (CASE WHEN contains(t, chr(13)) THEN 2 ELSE 0 END) + (CASE WHEN contains(t, chr(27) || '[') THEN 2 ELSE 0 END)
    + (CASE WHEN contains(t, '[1/') OR contains(t, '[ 1/') THEN 2 ELSE 0 END)
    + len(list_filter(head, lambda x: starts_with(x, 'Compiling ') OR starts_with(x, 'Checking ') OR starts_with(x, 'Downloading ')
        OR contains(x, '% |') OR contains(x, 'ETA') OR (starts_with(x, '[') AND contains(x, '/')))) // 2 AS score
  FROM h
)
SELECT id, CASE WHEN {_JSONISH.format('b')} THEN 'json' WHEN score >= 3 THEN 'log' ELSE 'code' END AS kind FROM s
"""


@query("classify_documents", _kind_sql("documents", "doc_id", "coalesce(text, '')"))
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _texts(spark, sf_dir).select(F.col("doc_id").alias("id"), classify.payload_kind(text).alias("kind"))


@query("classify_pages", _kind_sql("pages", "page_id", "coalesce(html, '')"))
def classify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), classify.payload_kind(F.coalesce("html", F.lit(""))).alias("kind"))


@query("classify_events", _kind_sql("events", "event_id", "props"))
def classify_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), classify.payload_kind(F.col("props")).alias("kind"))


_TIDY = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\f]*\r?(\n|$)', '\1', 'g'), '^\n+', ''), '\n\n\n+', chr(10) || chr(10), 'g'), '\n\n+$', chr(10))"""


@query("collapse_blank_lines", f"SELECT doc_id, {_TIDY} AS tidy FROM documents")
def collapse_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", code.tidy_lines(F.col("text")).alias("tidy"))


@query(
    "savings_rollup",
    f"""
WITH d AS (SELECT lang, strlen(text) AS b, strlen({_TIDY}) AS a FROM documents),
g AS (SELECT lang, count(*) AS n, coalesce(sum(b), 0)::BIGINT AS before, coalesce(sum(a), 0)::BIGINT AS after FROM d GROUP BY ROLLUP (lang))
SELECT lang, n, before, after, greatest(before - after, 0) AS saved, CASE WHEN before = 0 THEN 0.0 ELSE round(100.0 * greatest(before - after, 0) / before, 6) END AS saved_pct FROM g
""",
)
def savings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir, "lang")
    out = pipeline.savings(docs, tx.byte_length(F.col("text")), tx.byte_length(code.tidy_lines(F.col("text"))), "lang")
    return out.withColumn("saved_pct", F.round("saved_pct", 6))


@query("pipeline_trace", "SELECT p_partkey, strlen(body) AS input_bytes, strlen(out) AS output_bytes, strlen(body) - strlen(out) AS bytes_saved, out AS output FROM (SELECT *, rtrim(split_part(body, '#', 1)) AS out FROM (SELECT p_partkey, p_name || ' = ' || p_size || '  # ' || p_type AS body FROM part))")
def pipeline_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat("p_name", F.lit(" = "), F.col("p_size").cast("string"), F.lit("  # "), "p_type")
    rows = table(spark, sf_dir, "part").select("p_partkey", body.alias("body"))
    chain = pipeline.Pipeline().register(pipeline.CODE).register(pipeline.IDENTITY).register(pipeline.LOG)
    return chain.execute_traced(rows).select("p_partkey", "input_bytes", "output_bytes", "bytes_saved", "output")


@query(
    "strip_trailing_comments",
    r"""SELECT p_partkey, 'x = "http://h/' || p_size || '# no" + 1' || chr(10) || 'y = ' || p_size AS cleaned FROM part""",
)
def strip_trailing_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    body = F.concat(F.lit('x = "http://h/'), size, F.lit('# no" + 1  // '), "p_name", F.lit("\n/* "), "p_type", F.lit(" */\ny = "), size, F.lit(" # "), "p_brand")
    clean = code.clean_code(body)
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(clean, "\n\n", "\n").alias("cleaned"))


_LOG_LINE = "'[' || event_id || '/9999] ' || chr(27) || '[32m' || event_type || chr(27) || '[0m  ' || user_id || '% ' || chr(13) || '[' || event_id || '/9999] ' || chr(27) || '[1;31m' || event_type || chr(27) || '[0m  (3/4)  ' || user_id"


def _log_line():
    c = lambda x: F.col(x).cast("string")
    return F.concat(
        F.lit("["), c("event_id"), F.lit("/9999] \x1b[32m"), "event_type", F.lit("\x1b[0m  "), c("user_id"), F.lit("% \r["), c("event_id"), F.lit("/9999] \x1b[1;31m"), "event_type", F.lit("\x1b[0m  (3/4)  "), c("user_id")
    )


@query("log_frames_and_escapes", rf"SELECT event_id, f AS frame, regexp_replace(f, '\x1b\[[0-9;?]*[A-Za-z]', '', 'g') AS bare FROM (SELECT event_id, split_part({_LOG_LINE}, chr(13), -1) AS f FROM events)")
def log_frames_and_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = logs.last_frame(_log_line())
    return table(spark, sf_dir, "events").select("event_id", frame.alias("frame"), logs.strip_ansi(frame).alias("bare"))


@query("log_clean_line", "SELECT event_id, event_type || ' ' || user_id AS cleaned FROM events")
def log_clean_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", logs.clean_line(_log_line()).alias("cleaned"))


@query(
    "log_ticker_strip",
    r"SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('made ' || round(value, 1) || '% at ' || user_id || ' MiB/s ETA: 12s [====>  ] ' || event_type, '\b\d{1,3}(\.\d+)?\s*%', '', 'g'), '\b\d+(\.\d+)?\s*[kKmMgGtT]i?[bB]/s\b', '', 'g'), '\[\s*[=#-]{2,}[>\s]*\]', '', 'g'), '(?i)\b(eta|elapsed|remaining|took)\s*[:=]?\s*\d+[smh:\d]*', '', 'g')) AS stripped FROM events",
)
def log_ticker_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("made "), F.round("value", 1).cast("string"), F.lit("% at "), F.col("user_id").cast("string"), F.lit(" MiB/s ETA: 12s [====>  ] "), "event_type")
    return table(spark, sf_dir, "events").select("event_id", F.trim(logs.strip_tickers(line)).alias("stripped"))


@query(
    "log_run_compress",
    """
WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
l AS (SELECT user_id, i, CASE WHEN event_type IN ('click', 'view') THEN 'Compiling ' || event_type || (event_id % 7) ELSE event_type END AS line, event_type IN ('click', 'view') AS c FROM e),
r AS (SELECT *, sum(CASE WHEN c THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS run FROM l),
u AS (SELECT user_id, run, c, line, min(i) AS i FROM r GROUP BY ALL),
k AS (SELECT *, count(*) OVER (PARTITION BY user_id, run, c) AS n, row_number() OVER (PARTITION BY user_id, run, c ORDER BY i) AS pos,
      first_value(line) OVER (PARTITION BY user_id, run, c ORDER BY i) AS f, last_value(line) OVER (PARTITION BY user_id, run, c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM u),
p AS (
  SELECT user_id, i, 0 AS j, line, false AS always FROM k WHERE NOT c OR n <= 3
  UNION ALL SELECT user_id, i, 0, line, true FROM k WHERE c AND n > 3 AND pos = 1
  UNION ALL SELECT user_id, i, 1, 'compiled ' || n || ' crates (' || string_split(f, ' ')[2] || ' … ' || string_split(z, ' ')[2] || ')', true FROM k WHERE c AND n > 3 AND pos = 1
  UNION ALL SELECT user_id, i, 0, line, true FROM k WHERE c AND n > 3 AND pos = n
), q AS (SELECT *, lag(line) OVER (PARTITION BY user_id ORDER BY i, j) AS before FROM p)
SELECT user_id, string_agg(line, chr(10) ORDER BY i, j) AS compressed FROM q WHERE always OR before IS NULL OR before <> line GROUP BY user_id
""",
)
def log_run_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    line = F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit("Compiling "), "event_type", (F.col("event_id") % 7).cast("string"))).otherwise(F.col("event_type"))
    texts = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return texts.select("user_id", logs.clean_log(body).alias("compressed"))


@query("json_to_yaml_flat", "SELECT event_id, 'k: ' || (props::JSON ->> 'k') AS yaml FROM events")
def json_to_yaml_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", jsonyaml.flat_object_yaml(F.col("props"), ("k",)).alias("yaml"))


def _nested_json():
    return F.concat(F.lit('{"name": "'), "p_name", F.lit('", "sizes": ['), F.col("p_size").cast("string"), F.lit(', 1.50], "made": {"by": "'), "p_brand", F.lit('", "in": [], "ok": true}}'))


_QUOTED = r"""CASE WHEN regexp_matches({0}, '[\s:#&,]') OR {0} = '' OR lower({0}) IN ('true','false','null','yes','no','on','off','y','n','~') OR regexp_full_match({0}, '-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?') OR contains('-?:{{}}[],&*!|>''"%@`#', substr({0}, 1, 1)) THEN '"' || {0} || '"' ELSE {0} END"""


@query(
    "json_to_yaml_nested",
    f"SELECT p_partkey, 'name: ' || {_QUOTED.format('p_name')} || chr(10) || 'sizes:' || chr(10) || '  - ' || p_size || chr(10) || '  - 1.50' || chr(10) || 'made:' || chr(10) || '  by: ' || {_QUOTED.format('p_brand')} || chr(10) || '  in: []' || chr(10) || '  ok: true' AS yaml FROM part",
)
def json_to_yaml_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", jsonyaml.json_to_yaml(_nested_json()).alias("yaml"))


@query(
    "yaml_to_json",
    """SELECT p_partkey, '{"name":"' || p_name || '","sizes":[' || p_size || ',1.50],"made":{"by":"' || p_brand || '","in":[],"ok":true}}' AS json FROM part""",
)
def yaml_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", jsonyaml.yaml_to_json(jsonyaml.json_to_yaml(_nested_json())).alias("json"))


@query(
    "json_errors",
    """
SELECT p_partkey, p_partkey % 5 = 4 AS ok,
  CASE p_partkey % 5 WHEN 0 THEN 'Expecting property name enclosed in double quotes' WHEN 1 THEN 'Expecting '','' delimiter' WHEN 2 THEN 'Extra data' WHEN 3 THEN 'Expecting value' ELSE '' END AS message,
  CASE p_partkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 6 + length(p_name) WHEN 2 THEN 5 + length(p_size::VARCHAR) WHEN 3 THEN 2 ELSE -1 END::INT AS position
FROM part
""",
)
def json_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    bodies = [F.concat(F.lit("  {"), name, F.lit("}")), F.concat(F.lit('["'), name, F.lit('"   }')), F.concat(F.lit("\n ["), size, F.lit("] ["), size, F.lit("]")), F.concat(F.lit("\t "), name), F.concat(F.lit('{"a": "'), name, F.lit('"}\n'))]
    body = F.element_at(F.array(*bodies), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", jsonyaml.json_error(body).alias("e"))
    return rows.select("p_partkey", "e.ok", F.coalesce("e.message", F.lit("")).alias("message"), F.coalesce("e.position", F.lit(-1)).alias("position"))


_PAYLOADS = """(SELECT event_id, CASE event_id % 5 WHEN 0 THEN '  ' || props || chr(10) WHEN 1 THEN '[1/9] ' || event_type || chr(13) || 'x' WHEN 2 THEN repeat('Checking ' || event_type || chr(10), 7)
  WHEN 3 THEN '[' || user_id || ', 2]' ELSE 'x = ' || user_id || ' # ETA 3' END AS body FROM events)"""


@query("classify_payloads", _kind_sql(_PAYLOADS, "event_id", "body"))
def classify_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    bodies = [F.concat(F.lit("  "), "props", F.lit("\n")), F.concat(F.lit("[1/9] "), "event_type", F.lit("\rx")), F.repeat(F.concat(F.lit("Checking "), "event_type", F.lit("\n")), 7), F.concat(F.lit("["), user, F.lit(", 2]")), F.concat(F.lit("x = "), user, F.lit(" # ETA 3"))]
    body = F.element_at(F.array(*bodies), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), classify.payload_kind(body).alias("kind"))


@query(
    "language_of_parts",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' WHEN 3 THEN 'unknown' WHEN 4 THEN 'rust' ELSE 'python' END AS language FROM part""",
)
def language_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By first lines, a tie, and twice by the path's ending."""
    texts = ["  pub fn a\ndef b\nenum C", "class A:\n  def b\nfn c", "export function a", "{0} is no code", "def a\nstruct B", "fn a\nfn b"]
    bodies = [F.concat("p_name", F.lit("\n" + t)) for t in texts]
    key = (F.col("p_partkey") % 6 + 1).cast("int")
    path = F.element_at(F.array(*map(F.lit, ["", "", "", "a.txt", "", "A.PY"])), key)
    return table(spark, sf_dir, "part").select("p_partkey", classify.language(path, F.element_at(F.array(*bodies), key)).alias("language"))


@query("log_odd_lines", "SELECT event_id, chr(1) || event_type || chr(10) || 'a hello ' || chr(7) || ' b' || user_id || chr(10) || 'kept 1' AS cleaned FROM events")
def log_odd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A control character at a line's start, an escape before a later bell, lines that are dropped, and a title sequence."""
    user = F.col("user_id").cast("string")
    body = F.concat(F.lit("\x01"), "event_type", F.lit("\nprogress: 3\n|/-\na \x1b(B hello \x07 b"), user, F.lit("\n3 / 4\n\x1b]0;"), "event_type", F.lit("\x07kept 1"))
    return table(spark, sf_dir, "events").select("event_id", logs.clean_log(body).alias("cleaned"))


@query(
    "scopes_of_parts",
    """
SELECT 'p' || p_partkey || '.js' AS file_path, 'function' AS kind, 'f' || p_partkey AS name, 2 AS line_start, 4 AS line_end, 6 AS byte_start, 6 + strlen(s)::INT AS byte_end, 3 AS end_row, 1 AS end_col, s AS source
FROM (SELECT p_partkey, 'function f' || p_partkey || '(a) {' || chr(10) || '  const g = x => x + ' || p_size || ' // ü }' || chr(10) || '}' AS s FROM part)
""",
)
def scopes_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script per part, without semicolons, then one that is cut off."""
    key = F.col("p_partkey").cast("string")
    source = F.concat(F.lit("// é\nfunction f"), key, F.lit("(a) {\n  const g = x => x + "), F.col("p_size").cast("string"), F.lit(" // ü }\n}\nfunction cut() {\n  if (a) {\n"))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), key, F.lit(".js")).alias("file_path"), source.alias("source"))
    return scopes.parse_files(files).select("file_path", "kind", "name", "line_start", "line_end", "byte_start", "byte_end", "end_row", "end_col", "source")


_RUST = """p AS (SELECT p_partkey AS k, 'p' || p_partkey || '.rs' AS f, 'a' || p_size AS a FROM part),
s AS (SELECT k, f || ':struct:S' || k || ':3' AS id, a FROM p), n AS (SELECT k, f, f || ':function:f' || k || ':7' AS id FROM p)"""


@query(
    "graph_of_parts",
    f"""
WITH {_RUST}
SELECT a.id AS src_key, b.id AS dst_key, 'CALLS_FUNCTION' AS kind, 3.0::DOUBLE AS weight FROM n a JOIN n b ON b.k = a.k + 2
UNION ALL SELECT 'module::' || a.f, b.id, 'IMPORTS_MODULE', 2.0 FROM n a JOIN n b ON b.k = a.k + 1
UNION ALL SELECT id, id || '#field#' || a, 'HAS_PROPERTY', 1.0 FROM s
""",
)
def graph_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call, import and field edges of a source file per part."""
    files = _rust_files(spark, sf_dir)
    return graph.scope_graph(scopes.parse_files(files), scopes.parse_imports(files))[1]


@query(
    "nodes_of_parts",
    f"""
WITH {_RUST}
SELECT id AS key, 'S' || k AS name, 'struct' AS kind, 3 AS line_start, 5 AS line_end FROM s UNION ALL SELECT id, 'f' || k, 'function', 7, 9 FROM n
UNION ALL SELECT 'module::' || f, f, 'module', 1, 1 FROM p UNION ALL SELECT id || '#field#' || a, a, 'struct', 3, 5 FROM s
""",
)
def nodes_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _rust_files(spark, sf_dir)
    return graph.scope_graph(scopes.parse_files(files), scopes.parse_imports(files))[0].select("key", "name", "kind", "line_start", "line_end")


def _rust_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    k, one, two = (x.cast("string") for x in (key, key + 1, key + 2))
    source = F.concat(F.lit("use crate::f"), one, F.lit(";\n\nstruct S"), k, F.lit(" {\n    a"), F.col("p_size").cast("string"), F.lit(": u8,\n}\n\nfn f"), k, F.lit("() {\n    f"), two, F.lit("();\n}\n"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k, F.lit(".rs")).alias("file_path"), source.alias("source"))


@query(
    "focus_mass",
    "SELECT l_partkey AS key, round(sum(l_discount), 9) AS mass FROM lineitem WHERE l_discount >= 0.05 GROUP BY l_partkey",
)
def focus_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_discount").alias("similarity"))
    return graph.focus_from_hits(hits, 0.05).withColumn("mass", F.round("mass", 9))


@query("yaml_scalar_quoting", f"SELECT s, {_QUOTED.format('s')} AS scalar FROM (SELECT DISTINCT unnest([p_name, p_brand, p_type, p_size::VARCHAR]) AS s FROM part UNION SELECT c_mktsegment FROM customer UNION SELECT c_name FROM customer)")
def yaml_scalar_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    s = part.select(F.explode(F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string"))).alias("s"))
    s = s.union(customer.select("c_mktsegment")).union(customer.select("c_name")).distinct()
    return s.select("s", jsonyaml.quoted_scalar(F.col("s")).alias("scalar"))


@query(
    "language_vote",
    """
WITH h AS (SELECT doc_id, list_slice(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1, 80) AS head FROM documents),
t AS (SELECT doc_id, list_transform(head, lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')) AS head FROM h),
v AS (SELECT doc_id,
  len(list_filter(head, lambda x: starts_with(x, 'fn ') OR starts_with(x, 'pub fn ') OR starts_with(x, 'impl ') OR starts_with(x, 'struct ') OR starts_with(x, 'enum '))) AS r,
  len(list_filter(head, lambda x: starts_with(x, 'def ') OR starts_with(x, 'class ') OR starts_with(x, 'async def '))) AS p,
  len(list_filter(head, lambda x: starts_with(x, 'function ') OR starts_with(x, 'export function '))) AS j FROM t)
SELECT doc_id, CASE WHEN r >= p AND r >= j AND r > 0 THEN 'rust' WHEN p >= j AND p > 0 THEN 'python' WHEN j > 0 THEN 'javascript' ELSE 'unknown' END AS language FROM v
""",
)
def language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", classify.language(F.lit(""), F.col("text")).alias("language"))


@query(
    "line_offsets",
    """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, line, coalesce(sum(strlen(x) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_start, strlen(x) AS n_bytes FROM l
""",
)
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scopes.line_offsets(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", F.col("line").cast("long").alias("line"), "byte_start", F.col("n_bytes").cast("long").alias("n_bytes"))


_INTERVALS = "SELECT l_orderkey AS k, l_linenumber AS id, l_quantity::INT AS line_start, (l_quantity + l_partkey % 40)::INT AS line_end FROM lineitem"


@query(
    "containment_edges",
    f"WITH i AS ({_INTERVALS}) SELECT o.k, o.id AS owner_id, c.id AS child_id FROM i o JOIN i c ON o.k = c.k AND o.id <> c.id AND c.line_start >= o.line_start AND c.line_end <= o.line_end AND (c.line_start > o.line_start OR c.line_end < o.line_end)",
)
def containment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_quantity").cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), start.alias("line_start"), (F.col("l_quantity") + F.col("l_partkey") % 40).cast("int").alias("line_end"))
    return graph.containment(rows, rows, "k")


@query(
    "edge_dedupe_sum",
    """
WITH e AS (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem),
w AS (SELECT l_partkey AS src_key, l_suppkey AS dst_key, sum(CASE l_returnflag WHEN 'A' THEN 3.0 WHEN 'N' THEN 2.0 ELSE 1.0 END) AS weight FROM e GROUP BY ALL),
o AS (SELECT src_key, sum(weight) AS s FROM w GROUP BY ALL)
SELECT src_key, dst_key, round(weight / s, 9)::DOUBLE AS share FROM w JOIN o USING (src_key)
""",
)
def edge_dedupe_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "CALLS_FUNCTION").when(F.col("l_returnflag") == "N", "IMPORTS_MODULE").otherwise("HAS_PROPERTY")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src_key"), F.col("l_suppkey").alias("dst_key"), kind.alias("kind")).distinct()
    return graph.adjacency(rows.withColumn("weight", graph.edge_weight(F.col("kind")))).withColumn("share", F.round("share", 9))


_STEPS = 5


def _pagerank_sql() -> str:
    out = """
WITH n AS (SELECT 'n' || n_nationkey AS k FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region UNION ALL SELECT 's' || s_suppkey FROM supplier),
e AS (SELECT 'n' || n_nationkey AS s, 'r' || n_regionkey AS d, 2.0 AS w FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 3.0 FROM supplier UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 1.0 FROM supplier),
o AS (SELECT s, sum(w) AS t FROM e GROUP BY s), a AS (SELECT e.s, e.d, e.w / o.t AS h FROM e JOIN o USING (s)),
p AS (SELECT k, CASE WHEN k IN ('n3', 'n7') THEN 0.5 ELSE 0.0 END AS p FROM n), r0 AS (SELECT k, p AS r FROM p)"""
    for i in range(_STEPS):
        out += f""",
f{i} AS (SELECT a.d AS k, sum(r.r * a.h) AS f FROM r{i} r JOIN a ON a.s = r.k GROUP BY a.d), g{i} AS (SELECT 1 - coalesce(sum(f), 0) AS g FROM f{i}),
r{i + 1} AS (SELECT p.k, 0.15 * p.p + 0.85 * (coalesce(f.f, 0) + (SELECT g FROM g{i}) * p.p) AS r FROM p LEFT JOIN f{i} f USING (k))"""
    return out + f"\nSELECT k AS key, round(r, 9)::DOUBLE AS rank FROM r{_STEPS}"


def _nation_graph(spark: SparkSession, sf_dir: str):
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    n, r, s = (lambda c, p=p: F.concat(F.lit(p), F.col(c).cast("string")) for p in "nrs")
    nodes = nation.select(n("n_nationkey").alias("key")).union(region.select(r("r_regionkey"))).union(supplier.select(s("s_suppkey")))
    edges = nation.select(n("n_nationkey").alias("src_key"), r("n_regionkey").alias("dst_key"), F.lit(2.0).alias("weight"))
    edges = edges.union(supplier.select(s("s_suppkey"), n("s_nationkey"), F.lit(3.0))).union(supplier.select(n("s_nationkey"), s("s_suppkey"), F.lit(1.0)))
    return nodes, edges, spark.createDataFrame([("n3", 2.0), ("n7", 2.0)], "key string, mass double")


@query("pagerank_nations", _pagerank_sql())
def pagerank_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.personalized_pagerank(*_nation_graph(spark, sf_dir), iterations=_STEPS, tolerance=0.0)
    return out.select("key", F.round("rank", 9).alias("rank"))


@query("pagerank_nations_joins", _pagerank_sql())
def pagerank_nations_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by joins, as for a graph that doesn't fit in the driver."""
    out = graph.personalized_pagerank(*_nation_graph(spark, sf_dir), iterations=_STEPS, tolerance=0.0, small_graph=0)
    return out.select("key", F.round("rank", 9).alias("rank"))


def _features_sql(source: str) -> str:
    """feature lists of rows (id, t): tokens, pairs and character triples."""
    return f"""
w AS (SELECT id, t, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^A-Za-z0-9_]'), lambda x: length(x) >= 2) AS ws,
      regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x1f\\x7f-\\x{{9f}}]', '', 'g') AS c FROM {source}),
x AS (SELECT id, unnest(ws) AS feature FROM w UNION ALL SELECT id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
      UNION ALL SELECT id, unnest(list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3))) FROM w WHERE length(c) >= 3),
tf AS (SELECT id, feature, count(*) AS tf FROM x GROUP BY ALL)"""


_DOCS = "d AS (SELECT doc_id AS id, text AS t FROM documents)"
_IDF = "n AS (SELECT greatest(count(*), 1) AS n FROM d), idf AS (SELECT feature, ln((n + 1.0) / (count(*) + 1.0)) + 1 AS idf FROM tf, n GROUP BY feature, n)"


@query("idf_terms", f"WITH {_DOCS}, {_features_sql('d')}, {_IDF} SELECT feature, round(idf, 9) AS idf FROM idf")
def idf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    idf = vectors.fit_idf(table(spark, sf_dir, "documents"), "doc_id", "text")
    return idf.select("feature", F.round("idf", 9).alias("idf"))


@query(
    "tfidf_cosine",
    f"""
WITH {_DOCS}, {_features_sql('d')}, {_IDF},
v AS (SELECT id, feature, tf * idf AS w FROM tf JOIN idf USING (feature)),
qd AS (SELECT 0 AS id, '{SEARCH}' AS t),
qw AS (SELECT id, t, list_filter(regexp_split_to_array(t, '[^A-Za-z0-9_]'), lambda x: length(x) >= 2) AS ws, t AS c FROM qd),
qx AS (SELECT unnest(ws) AS feature FROM qw UNION ALL SELECT unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM qw
       UNION ALL SELECT unnest(list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3))) FROM qw),
qv AS (SELECT feature, count(*) * coalesce(any_value(idf), 1.0) AS w FROM qx LEFT JOIN idf USING (feature) GROUP BY feature),
s AS (SELECT v.id, sum(v.w * qv.w) AS dot FROM v JOIN qv USING (feature) GROUP BY v.id),
m AS (SELECT id, sqrt(sum(w * w)) AS m FROM v GROUP BY id)
SELECT s.id AS doc_id, round(least(greatest(dot / (m.m * (SELECT sqrt(sum(w * w)) FROM qv)), 0), 1), 6) AS similarity FROM s JOIN m USING (id)
""",
)
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = written(vectors.counted(docs, "doc_id", "text"), "counts")
    idf = written(vectors.idf_of(counts), "idf")
    lengths = vectors.norms(vectors.weights(counts, "doc_id", idf), "doc_id")
    out = vectors.similarities(SEARCH, counts, lengths, "doc_id", idf)
    return out.select("doc_id", F.round("similarity", 6).alias("similarity"))


def _part_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"), F.col("p_partkey").cast("string").alias("id"), F.lit("part").alias("file_path"), F.col("p_name").alias("name"), F.lit("function").alias("kind"),
        F.col("p_partkey").alias("line_start"), F.col("p_partkey").alias("line_end"), F.col("p_type").alias("source"),
    )


_PARTS = "part1 widget prt2 steel"
_SIM = "(1 - levenshtein(n, t) / greatest(length(n), length(t))::DOUBLE)"


@query(
    "symbol_rank",
    f"""
WITH c AS (SELECT p_partkey, lower(p_name) AS n, unnest(['part1', 'widget', 'prt2', 'steel']) AS t FROM part),
b AS (SELECT p_partkey, max(CASE WHEN n = t THEN 1.0::DOUBLE WHEN starts_with(n, t) OR starts_with(t, n) THEN 0.88::DOUBLE WHEN contains(n, t) THEN 0.72::DOUBLE WHEN {_SIM} >= 0.6 THEN {_SIM} * 0.85::DOUBLE ELSE 0 END) AS c FROM c GROUP BY 1)
SELECT p_partkey::VARCHAR AS id, row_number() OVER (ORDER BY c DESC, p_partkey)::INT AS rank, round(c, 9) AS confidence FROM b WHERE c > 0
""",
)
def symbol_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankers.symbol_hits(_part_candidates(spark, sf_dir), _PARTS).select("id", "rank", F.round("confidence", 9).alias("confidence"))


@query(
    "keyword_rank",
    r"""
WITH h AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)(?:^|[^0-9A-Za-z_\x80-\x{10ffff}])(?:stupid|question|about|the|nation|of|inflation)(?:[^0-9A-Za-z_\x80-\x{10ffff}]|$)')) AS any_hit, text FROM documents),
k AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[^\pL\pN\pM_]+'), lambda x: lower(x) IN ('stupid', 'question', 'about', 'the', 'nation', 'of', 'inflation')) AS l FROM h),
s AS (SELECT doc_id, len(l) AS hits, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM k WHERE len(l) > 0),
c AS (SELECT doc_id, hits, greatest(least(hits / 4.0, 1.0), least(hits / greatest(words, 1)::DOUBLE, 1.0))::DOUBLE AS c FROM s)
SELECT doc_id::VARCHAR AS id, row_number() OVER (ORDER BY hits DESC, c DESC, doc_id)::INT AS rank, round(c, 9) AS confidence FROM c
""",
)
def keyword_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("file_path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.col("text").alias("source"))
    return rankers.keyword_hits(docs, SEARCH).select("id", "rank", F.round("confidence", 9).alias("confidence"))


def _line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits on windows of orders: three rankers over lineitem, a file per part brand."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    ranker = F.when(F.col("l_linenumber") % 3 == 0, "ast").when(F.col("l_linenumber") % 3 == 1, "regex").otherwise("vector")
    start = (F.col("l_orderkey") % 5000 * 40 + F.col("l_linenumber") * 3).cast("int")
    weight = F.when(ranker == "ast", 1.0).when(ranker == "regex", 0.85).otherwise(1.15)
    return rows.select(
        ranker.alias("ranker"), weight.alias("weight"), F.col("l_suppkey").cast("int").alias("rank"), (F.col("l_quantity") / 52).alias("confidence"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("f"), (F.col("l_orderkey") / 5000).cast("int").cast("string")).alias("file_path"),
        start.alias("line_start"), (start + F.col("l_linenumber")).cast("int").alias("line_end"), F.lit("").alias("content"),
    )


_HITS = """h AS (
  SELECT CASE l_linenumber % 3 WHEN 0 THEN 'ast' WHEN 1 THEN 'regex' ELSE 'vector' END AS ranker, CASE l_linenumber % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.85::DOUBLE ELSE 1.15::DOUBLE END AS weight,
    l_suppkey::INT AS rank, l_quantity / 52 AS confidence, l_orderkey || '-' || l_linenumber AS id, 'f' || (l_orderkey // 5000) AS file_path,
    (l_orderkey % 5000 * 40 + l_linenumber * 3)::INT AS line_start, (l_orderkey % 5000 * 40 + l_linenumber * 4)::INT AS line_end, l_orderkey AS o
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(
    "rrf_cluster_merge",
    f"""
WITH RECURSIVE {_HITS}, d AS (SELECT DISTINCT id, file_path, line_start, line_end, o FROM h),
e AS (SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON a.file_path = b.file_path AND a.o = b.o AND a.line_end - a.line_start < 20 AND b.line_end - b.line_start < 20
      AND greatest(a.line_end, b.line_end) - least(a.line_start, b.line_start) + 1 <= 15 + greatest(a.line_end - a.line_start, b.line_end - b.line_start) + 1),
r AS (SELECT id AS n, id AS m FROM d UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n),
g AS (SELECT n, count(*) AS size FROM r GROUP BY n)
SELECT n AS id, size FROM g
""",
)
def rrf_cluster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.clustered(_line_hits(spark, sf_dir)).select("cluster", "id").distinct()
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.collect_list("id").alias("ids"))
    return sizes.select(F.explode("ids").alias("id"), "size")


@query(
    "rrf_fuse",
    """
WITH h AS (
  SELECT 'vector' AS ranker, 1.15::DOUBLE AS weight, p_size AS rank, p_size / 60.0 AS c, p_partkey AS id FROM part
  UNION ALL SELECT 'ast', 1.0, (p_partkey % 97)::INT + 1, (p_partkey % 97) / 100.0, p_partkey FROM part
  UNION ALL SELECT 'regex', 0.85, (p_partkey % 31)::INT + 1, 0.5, p_partkey FROM part WHERE p_partkey % 2 = 0),
m AS (SELECT id, max(c)::DOUBLE AS c FROM h GROUP BY id),
w AS (SELECT h.id, m.c, m.c > 0.95 AS o, ranker, CASE WHEN m.c > 0.95 THEN weight * (1 + h.c::DOUBLE) ELSE weight / (60.0::DOUBLE + h.rank) END AS x FROM h JOIN m USING (id)),
s AS (SELECT id, c, o, coalesce(max(x) FILTER (ranker = 'ast'), 0.0::DOUBLE) + coalesce(max(x) FILTER (ranker = 'regex'), 0.0::DOUBLE) + coalesce(max(x) FILTER (ranker = 'vector'), 0.0::DOUBLE) AS p FROM w GROUP BY id, c, o),
t AS (SELECT *, CASE WHEN o THEN p + 1000.0::DOUBLE + c ELSE p END AS score FROM s)
SELECT id::VARCHAR AS id, round(score, 9)::DOUBLE AS score, round(c, 9)::DOUBLE AS confidence, o AS override_floated, 'line ' || id AS content,
  row_number() OVER (ORDER BY o DESC, CASE WHEN o THEN c END DESC NULLS LAST, score DESC, id * 100, 'f' || (id % 50), id::VARCHAR)::INT AS position FROM t
""",
)
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    at = (F.col("p_partkey") * 100).cast("int")
    rest = (F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string")).alias("file_path"), at.alias("line_start"), at.alias("line_end"), F.concat(F.lit("line "), F.col("p_partkey").cast("string")).alias("content"))
    hit = lambda df, ranker, weight, rank, c: df.select(F.lit(ranker).alias("ranker"), F.lit(weight).alias("weight"), rank.cast("int").alias("rank"), c.cast("double").alias("confidence"), *rest)
    key = F.col("p_partkey")
    hits = hit(part, "vector", 1.15, F.col("p_size"), F.col("p_size") / 60).union(hit(part, "ast", 1.0, key % 97 + 1, key % 97 / 100)).union(hit(part.where(key % 2 == 0), "regex", 0.85, key % 31 + 1, F.lit(0.5)))
    return fusion.blend(hits).select("id", F.round("score", 9).alias("score"), F.round("confidence", 9).alias("confidence"), "override_floated", "content", "position")


@query(
    "context_listagg",
    """
WITH l AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
SELECT o_custkey AS query_id, string_agg('# f' || o_custkey || ' ' || o_orderkey || ':' || p || '-' || (p + 1) || chr(10) || o_orderpriority || chr(10), chr(10) ORDER BY p) AS context FROM l GROUP BY o_custkey
""",
)
def context_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").withColumn("position", position)
    rows = rows.select(F.col("o_custkey").alias("query_id"), "position", F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("file_path"), F.col("position").alias("line_start"), (F.col("position") + 1).alias("line_end"), F.col("o_orderpriority").alias("content"))
    return fusion.context(rows)


# Small programs of our own.
PROGRAMS = (
    ("shop/cart.py", "import json\nfrom shop.tax import rate, levy as duty\n\n\nclass Cart:\n    def __init__(self):\n        self.items = []\n\n    @property\n    def total(self):\n        return sum(self.items) * rate()\n\n\ndef checkout(cart):\n    return receipt(Cart())\n\n\ndef receipt(cart):\n    return json.dumps(cart.total)\n"),
    ("shop/tax.py", "def rate():\n    return 1.2\n\n\ndef levy(x):\n    return x * rate()\n"),
    ("core/pool.rs", "use std::sync::{Arc, Mutex};\nuse crate::job::Job;\n\npub struct Pool {\n    pub size: usize,\n    queue: Vec<Job>,\n}\n\nimpl Pool {\n    pub fn new(size: usize) -> Self {\n        Pool { size, queue: Vec::new() }\n    }\n\n    pub fn run(&mut self) {\n        dispatch(self);\n    }\n}\n\nfn dispatch(pool: &mut Pool) {\n    Pool::new(1);\n    let s = \"}\"; // }\n}\n"),
    ("web/app.js", "import React from 'react';\n\nexport function render(root) {\n  return mount(root);\n}\n\nconst mount = (root) => {\n  return root;\n};\n\nexport class View {\n  draw() { return render(this); }\n}\n"),
)


def _programs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROGRAMS), "file_path string, source string")


def _rows_sql(names: tuple[str, ...], rows) -> str:
    cell = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


@query(
    "scopes_of_programs",
    _rows_sql(
        ("file_path", "kind", "name", "line_start", "line_end"),
        [
            ("shop/cart.py", "class", "Cart", 3, 13), ("shop/cart.py", "method", "__init__", 6, 8), ("shop/cart.py", "method", "total", 8, 13), ("shop/cart.py", "function", "checkout", 12, 17), ("shop/cart.py", "function", "receipt", 16, 19),
            ("shop/tax.py", "function", "rate", 1, 4), ("shop/tax.py", "function", "levy", 3, 6),
            ("core/pool.rs", "struct", "Pool", 4, 7), ("core/pool.rs", "impl", "Pool", 9, 17), ("core/pool.rs", "function", "new", 10, 12), ("core/pool.rs", "function", "run", 14, 16), ("core/pool.rs", "function", "dispatch", 19, 22),
            ("web/app.js", "function", "render", 3, 5), ("web/app.js", "function", "mount", 7, 9), ("web/app.js", "class", "View", 11, 13),
        ],
    ),
)
def scopes_of_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.parse_files(_programs(spark)).select("file_path", "kind", "name", "line_start", "line_end")


@query("imports_of_programs", _rows_sql(("file_path", "name"), [("shop/cart.py", x) for x in ("Cart", "json", "rate", "tax")] + [("core/pool.rs", x) for x in ("Arc", "Job", "Mutex", "job", "std", "sync")] + [("web/app.js", "React")]))
def imports_of_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.parse_imports(_programs(spark))


@query("graph_of_programs")
def graph_of_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _programs(spark)
    return graph.scope_graph(scopes.parse_files(files), scopes.parse_imports(files))[1]


@query("retrieval_of_programs")
def retrieval_of_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = RetrievalEngine().index(_programs(spark)).query("dispatch a job in the pool", 4)
    return out.blended.select("position", "id", "file_path", "line_start", "line_end", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "override_floated")


@query(
    "routed_savings",
    """
WITH p AS (SELECT 'json' AS kind, strlen(props) AS b, strlen('k: ' || (props::JSON ->> 'k')) AS a FROM events
  UNION ALL SELECT 'code', strlen(p_name || ' = 1 // ' || p_type), strlen(p_name || ' = 1') FROM part),
g AS (SELECT kind, count(*) AS n, sum(b)::BIGINT AS before, sum(a)::BIGINT AS after FROM p GROUP BY ROLLUP (kind))
SELECT kind, n, before, after, greatest(before - after, 0) AS saved, round(100.0 * greatest(before - after, 0) / before, 6) AS saved_pct FROM g
""",
)
def routed_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = table(spark, sf_dir, "events").select(F.col("props").alias("body")).union(table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" = 1 // "), "p_type")))
    out = pipeline.savings(pipeline.routed(bodies), tx.byte_length(F.col("body")), tx.byte_length(F.col("output")), "kind")
    return out.withColumn("saved_pct", F.round("saved_pct", 6))


@query("demo_flow")
def demo_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared kinds, filters, index of the cleaned code, query, context and token telemetry in one flow."""
    import public_tokenizers

    counter = pipeline.token_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    code_files = _programs(spark).select(F.col("file_path").alias("name"), F.lit("code").alias("declared"), F.col("source").alias("body"))
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("name"), F.lit("json").alias("declared"), F.col("props").alias("body"))
    build = table(spark, sf_dir, "events").select(F.concat(F.lit("l"), F.col("event_id").cast("string")).alias("name"), F.lit("log").alias("declared"), _log_line().alias("body"))
    return demo.flow(code_files.union(events).union(build), "dispatch a job in the pool", counter, top_k=6, declared="declared")


@query("token_telemetry")
def token_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens saved on composed payloads, counted with a public byte-pair vocabulary."""
    import public_tokenizers

    counter = pipeline.token_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    bodies = table(spark, sf_dir, "events").select(F.col("props").alias("body")).union(table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" = 1 // "), "p_type")))
    return pipeline.telemetry(pipeline.routed(bodies), counter)
