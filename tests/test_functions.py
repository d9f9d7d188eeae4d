import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import hashing, naming, sampling
from shelfmark.functions.unicode import nfkc
from shelfmark.sources import documents
from tests.conftest import rows


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_suffix_and_stem(spark):
    names = ["a.tar.gz", ".hidden", "x.", "plain", "a.b.c"]
    assert one(spark, names, naming.suffix) == [".gz", "", "", "", ".c"]
    assert one(spark, names, naming.stem) == ["a.tar", ".hidden", "x.", "plain", "a.b"]


def test_meaningful(spark):
    cases = {"quarterly-report": True, "a1b2c3d4e5f60718": False, "IMG_00042": False, "abc": False, "季度报告": True, "a12345678": False, "ab1234": True, "  __  ": False, "recording-0123456789abcdef.x": False}
    assert one(spark, cases, lambda x: naming.is_meaningful(nfkc(x))) == list(cases.values())


def test_portable_names(spark):
    cases = {"CON": "CON-文件", '报告<>:"/\\|?*.': "报告", "..a..": "a", "ｆｕｌｌ": "full", "a" * 40: "a" * 15}
    assert one(spark, cases, lambda x: naming.clipped(nfkc(x), 15)) == list(cases.values())
    assert one(spark, ["com1"], lambda x: naming.clipped(x, 8)) == ["com1-文件"]


def test_sizes(spark):
    assert one(spark, [0, 1023, 1024, 1152, 1024**2, 5 * 1024**3, 3 * 1024**5], naming.human_size, "long") == ["0 B", "1023 B", "1.00 KB", "1.12 KB", "1.00 MB", "5.00 GB", "3072.00 TB"]


def test_markdown_cells(spark):
    assert one(spark, [r"| a \| b | c |", "| x |  |"], lambda x: F.array_join(naming.markdown_cells(x), "~")) == ["a | b~c", "x~"]


def test_paths(spark):
    cases = {"a/../b": "b", "../x": None, "a/../../x": None, "/abs": None, "./a//b": "a/b", ".": None}
    assert one(spark, cases, naming.normalized_path) == list(cases.values())


def test_bad_boolean(spark):
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, ["perhaps"], naming.parsed_bool)


@pytest.mark.parametrize("size", [0, 1, 65536, 65537, 100_000, 131_072, 200_000])
def test_fingerprint_reads_both_ends(spark, size):
    raw = bytes(k * 7 % 251 for k in range(size))
    df = spark.createDataFrame([(bytearray(raw),)], "c binary")
    tail = raw[-65536:] if size > 65536 else b""
    want = hashlib.sha256(f"v2:{size}:5:".encode() + raw[:65536] + tail).hexdigest()
    assert df.select(hashing.content_fingerprint(F.lit(size), F.lit(5), F.col("c"))).head()[0] == want


def spread(total, count):
    """Evenly spread positions in plain Python, rounded half to even."""
    if total <= 0 or count <= 0:
        return []
    if total <= count or count == 1:
        return list(range(min(total, count)))
    return sorted({round(k * (total - 1) / (count - 1)) for k in range(count)})


def test_even_positions(spark):
    df = spark.range(600).selectExpr("cast(id % 60 as int) - 2 as t", "cast(id % 13 as int) - 1 as c")
    for r in df.select("t", "c", sampling.even_indexes(F.col("t"), F.col("c")).alias("x")).collect():
        got = list(r["x"])
        assert got == spread(r["t"], r["c"]) and len(got) == max(0, min(r["t"], r["c"]))
        if r["c"] > 1 and r["t"] > r["c"]:
            assert got[0] == 0 and got[-1] == r["t"] - 1


def test_times(spark):
    assert one(spark, [100.0], lambda x: sampling.even_times(x, F.lit(5)), "double") == [[5.0, 27.5, 50.0, 72.5, 95.0]]
    assert rows(spark.range(1).select(F.size(sampling.even_times(F.lit(10.0), F.lit(50))))) == [(9,)]
