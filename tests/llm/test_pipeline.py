"""The pipeline stage by stage against brute force, and its registration."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tarnwork.llm import mixing, packing, toxicity
from tests.llm.test_dedup import near_rows, squeeze
from tests.llm.test_mixing import count, plain_targets
from tests.llm.test_near import brute_kept
from tests.llm.test_scans import toxic_table


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    toxic, labels, _ = toxic_table(spark)
    rows = [(10_000 + i if i is not None else None, t, "en", f"s{k % 4}", len(t or "")) for k, (i, t) in enumerate(near_rows())]
    own = toxic.select("doc_id", "text", F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("doc_id") % 3).alias("source"), F.length("text").alias("n_chars"))
    docs = own.union(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")).withColumn("n_chars", F.col("n_chars").cast("long"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], tables).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(x.columns == docs.columns for x in seen[:-1])
    rows = [[(r.doc_id, r.text, r.source) for r in x.collect()] for x in seen[:-1]]
    model = toxicity.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, rows[1])) == sorted(key(r) for r in rows[0] if model.score(r[1]) < 0.5)
    best = {}
    for r in rows[1]:
        rank = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        best[squeeze(r[1])] = min(best.get(squeeze(r[1]), (rank, r)), (rank, r), key=lambda x: x[0])
    assert sorted(str(r[0]) for r in rows[2]) == sorted(str(r[0]) for _, r in best.values())
    # The stage links texts of five-word similarity besides those of near fingerprints.
    assert sorted(str(r[0]) for r in rows[3]) == sorted(str(rows[2][i][0]) for i in brute_kept([r[:2] for r in rows[2]]))
    sizes, target = plain_targets(rows[3])
    for s in sizes:
        own = sum(count(r[1]) for r in rows[4] if r[2] == s)
        assert abs(own - target[s]) <= max(count(r[1]) for r in rows[3] if r[2] == s)
    ids = packing.word_ids(packing.default_tokenizer())
    packed = seen[-1].collect()
    assert sum(r.length for r in packed) == sum(len(ids.of_text(r[1] or "")) // 4 + 1 for r in rows[4])
    assert max(r.offset + r.length for r in packed) <= packing.WINDOW
    assert mixing.MOST_COPIES == 2


def test_registered(spark, tables):
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert corpus_pipeline.run(spark, tables).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
