"""Packing: the ids are the tokenizer's, every id is in one piece, windows are full."""

import tracemalloc
import zlib
from array import array

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tarnwork.llm import packing

tokenizers = pytest.importorskip("tokenizers")
TEXTS = ["Hello, world! It's the 3rd don't-stop.", "", None, "   ", "été Çà NAÏVE éa", "日本語 テスト", "<|endoftext|> x", "a\x1cb c", "İstanbul ΣΑΣ ǅ ʰa", "x" * 5000, "word " * 9000, "don't 'S'LL a''re 12a3 ¾ ² a_b"]


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(packing.default_tokenizer())


def expected(tokenizer, text):
    return array("I", tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_ids_of_text(tokenizer, text):
    assert packing.WordIds(packing.default_tokenizer()).of_text(text) == expected(tokenizer, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aABéÉßİıŉ'’sStT.,!19 \n\t́ \u0085ªº²"), st.characters(max_codepoint=0x2FF)), max_size=30))
def test_ids_of_any_latin_text(text):
    ids = packing.word_ids(packing.default_tokenizer())
    assert ids.of_text(text) == expected(ids.tokenizer, text)


def test_round_trip(spark, tokenizer):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    got = packing.pack(docs).collect()
    whole = {i: expected(tokenizer, t) + array("I", [1]).tobytes() for i, t, _ in rows}
    windows, seen = {}, {}
    for r in got:
        own = whole[r.doc_id]
        assert r.doc_tokens == len(own) // 4 and 0 < r.length <= packing.WINDOW
        assert zlib.crc32(own[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    for i, places in seen.items():
        copies = sum(x[0] == i for x in rows)
        assert sorted(places) == sorted(list(range(len(whole[i]) // 4)) * copies)
    for spans in windows.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= packing.WINDOW


def test_windows_are_near_equal_and_few():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, packing.PIECE + 1, 2000)
    part = packing.packed(sizes)
    sums = np.bincount(part, sizes)
    assert sums.max() <= packing.WINDOW and sums.sum() == sizes.sum()
    assert len(sums) <= -(-sizes.sum() // packing.WINDOW) + 2
    assert sums.max() - sums.min() < 64


@pytest.mark.parametrize("sizes", [[], [2047], [2000, 2000, 2000], [1] * 10, [512] * 9])
def test_small_blocks(sizes):
    part = packing.packed(np.array(sizes, np.int64))
    assert len(part) == len(sizes) and np.bincount(part, sizes).max(initial=0) <= packing.WINDOW


def test_a_block_of_empty_texts():
    """The most pieces that a block can hold: one id each."""
    n = packing.WINDOW * packing.BLOCK_WINDOWS
    rows = pd.DataFrame({"doc_id": range(n), "start": 0, "length": 1, "ids_crc32": 0, "doc_tokens": 1, "uid": range(n), "block": 0})
    tracemalloc.start()
    out = packing.pack_block(rows)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    fill = out.groupby("sequence_id")["length"].sum()
    assert fill.max() <= packing.WINDOW and len(fill) <= packing.BLOCK_WINDOWS + 2


def test_bundles_hold_neighbours():
    sizes = np.array([3, 500, 60, 1, 1, 64, 63, 63, 2])
    of = packing.bundled(sizes)
    assert len(of) == len(sizes) and all((of == of[i]).sum() == 1 for i in (1, 5))
    sums = np.bincount(of, sizes)
    assert all(s < 2 * packing.BUNDLE for b, s in enumerate(sums) if (of == b).sum() > 1)


def test_many_null_texts(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = packing.pack(docs).toPandas()
    assert len(got) == 20_000 and got.groupby("sequence_id")["length"].sum().max() <= packing.WINDOW and got["sequence_id"].nunique() <= 11


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
