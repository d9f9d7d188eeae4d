"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import bpe, exact_dedup, fingerprints, hmm, mixing, near_dedup, pii, quality_crf, secrets, url_filters
from tests.conftest import rows

CLASHES = ["token", "bucket", "row", "score", "kept", "digest", "rep", "a", "block", "slot", "word", "bit", "ids", "phase", "order", "known", "label", "__sha", "__at"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, data):
    df = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in data], SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def odd(spark):
    long = "word " * 20_000
    data = [(1, None, "x"), (2, "", "x"), (3, "same text here with more words", None), (3, "same text here with more words", None), (4, "same text here with more words", "x"), (None, "no name but some words in it", "y"), (None, None, "y"), (5, long, "x"), (6, long + "end", "x"), (7, " \n\t ", "y"), (8, "héllo wörld ẞ 😀", "y"), (9, "\u0001 control", "z")]
    return frame(spark, data)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (3, 1, 0), (5, 0, 0), (8, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


OPERATORS = {
    "pii": lambda d, _: pii.find_personal_data(d),
    "quality": quality_crf.quality,
    "hmm": lambda d, _: hmm.lm_scores(d),
    "mix": lambda d, _: mixing.mix(d, block_chars=1000),
    "secrets": lambda d, _: secrets.find_secrets(d),
    "exact": lambda d, _: exact_dedup.exact_dedup(d, keep="largest"),
    "near": lambda d, _: near_dedup.near_duplicates(d, 85),
    "fingerprints": lambda d, _: fingerprints.fingerprints(d, samples=8),
    "bpe": lambda d, _: bpe.bpe(d, tokenizer()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(odd, labels, name):
    got = OPERATORS[name](odd, labels)
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted((r["doc_id"] for r in odd.collect()), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, labels, name):
    assert OPERATORS[name](odd.limit(0), labels.limit(0)).count() == 0


def test_stages_keep_columns_and_rows(spark, odd, labels, tmp_path):
    import corpus_pipeline as p

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.filter("a <> 'clash'").count() == 0
        assert out.count() <= docs.count()
    once = p.exact_duplicates(spark, odd, str(tmp_path))
    assert rows(once, "doc_id", "text") == sorted([(4, "same text here with more words"), (None, "no name but some words in it"), (5, "word " * 20_000), (6, "word " * 20_000 + "end"), (7, " \n\t "), (8, "héllo wörld ẞ 😀"), (9, "\u0001 control"), (2, "")], key=repr)
    mixed = p.mix_sources(spark, odd, str(tmp_path))
    assert mixed.count() == odd.count()


def test_url_edges(spark):
    captures = spark.createDataFrame([(1, "http://User@A.Example.com:80/x/y?q", 5), (1, "http://User@A.Example.com:80/x/y?q", 5), (2, None, 5), (None, "no url", 5), (3, "https://example.com/xy", None), (4, "https://example.com./x", 9)], "page_id long, url string, fetched int").withColumns({c: F.lit(0) for c in ("rule", "since", "row", "rank")})
    entries = spark.createDataFrame([("example.com", "block", 1), ("example.com", "removed", 8), ("example.com/x", "allow", 3), ("example.com/x", "allow", 3), ("a.example.com", None, 1), (None, "block", 1)], "rule string, verdict string, day int").withColumn("url", F.lit(0))
    got = rows(url_filters.filter_urls(captures, entries), "page_id", "verdict", "rule")
    assert got == sorted([(1, "block", "example.com")] * 2 + [(2, None, None), (None, None, None), (3, None, None), (4, "allow", "example.com/x")], key=repr)
    assert url_filters.filter_urls(captures, entries.limit(0)).filter("verdict is not null").count() == 0
    assert url_filters.filter_urls(captures.limit(0), entries).count() == 0
    assert rows(url_filters.intervals(entries)) == [("example.com", "block", 1, 8), ("example.com/x", "allow", 3, None)]


def test_the_pipeline_drops_near_copies_between_80_and_85_percent(spark, tmp_path):
    import corpus_pipeline as p

    words = [f"w{k}" for k in range(204)]
    changed = [f"x{k}" if k in (20, 50, 120, 170) else w for k, w in enumerate(words)]
    # 180 of 220 shingles are shared: 81.8 %.
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed))], "doc_id long, text string")
    assert [r["doc_id"] for r in p.near_duplicate_groups(spark, docs, str(tmp_path)).collect()] == [1]
