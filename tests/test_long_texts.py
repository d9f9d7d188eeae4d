"""Queries over texts longer than the 64 KiB that a fingerprint of files reads from each end."""

import hashlib

import duckdb
import pytest

from shelfmark.oracle import SQL
from shelfmark.queries import QUERIES
from shelfmark.views import EPOCH
from tests.oracle import compare, connection

BYTES = 65536


@pytest.fixture(scope="module")
def long_dir(tmp_path_factory):
    """Texts around one and two chunks, every second one labelled; sizes come twice, as every fourth file has a record of its state."""
    base = str(tmp_path_factory.mktemp("long"))
    numbers = " ".join(map(str, range(60_000)))
    texts = [None, "", "short", "ü" * 40_000, *(numbers[:n] for n in (BYTES - 1, BYTES, BYTES + 1, 2 * BYTES - 1, 2 * BYTES, 2 * BYTES + 1, 200_000) for _ in range(8))]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    con.sql(f"COPY documents TO '{base}/documents.parquet' (FORMAT parquet)")
    con.sql(f"COPY (SELECT doc_id, CAST(doc_id % 3 > 0 AS INTEGER) AS quality, 0 AS toxic FROM documents WHERE doc_id % 2 = 0 OR doc_id % 7 = 3) TO '{base}/labels.parquet' (FORMAT parquet)")
    return base


def test_changed_versions(spark, long_dir):
    df = QUERIES["changed_versions"](spark, long_dir)
    assert df.filter("previous_fingerprint <> ''").count() > 0
    compare(df, connection(long_dir), SQL["changed_versions"])


def test_content_fingerprint(spark, long_dir):
    df = QUERIES["content_fingerprint"](spark, long_dir)
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{long_dir}/documents.parquet'").fetchall()
    want = {hashlib.sha256(f"v2:{len(raw)}:{(i * 61 + EPOCH) * 1_000_000_000 + 5}:".encode() + raw).hexdigest() for i, raw in ((i, (t or "").encode()) for i, t in texts)}
    assert {r["fingerprint"] for r in df.collect()} == want
    compare(df, connection(long_dir), SQL["content_fingerprint"])


def test_evidence_index(spark, long_dir):
    compare(QUERIES["evidence_index"](spark, long_dir), connection(long_dir), SQL["evidence_index"])


def test_intent_index(spark, long_dir):
    compare(QUERIES["intent_index"](spark, long_dir), connection(long_dir), SQL["intent_index"])


def test_intent_lookup(spark, long_dir):
    df = QUERIES["intent_lookup"](spark, long_dir)
    assert df.filter("intent is not null").count() > 0
    compare(df, connection(long_dir), SQL["intent_lookup"])


@pytest.mark.parametrize("name", ["intent_index", "intent_lookup"])
def test_joins_move_no_texts(spark, long_dir, name):
    def sides(plan):
        children = [plan.children().apply(k) for k in range(plan.children().size())]
        return [c.output().mkString(",") for c in children if plan.nodeName() == "Join"] + [s for c in children for s in sides(c)]

    found = sides(QUERIES[name](spark, long_dir)._jdf.queryExecution().optimizedPlan())
    assert len(found) == 4 and not [s for s in found if "text#" in s or "content#" in s]
