import pytest
from pyspark.sql import functions as F

from shelfmark.dims import extension_table
from shelfmark.functions.hashing import config_digest
from shelfmark.operators import capability, commit, history, jobs, report, sync
from shelfmark.plans.planner import Config, make_plan
from shelfmark.streaming.jobs import job_states, transition
from tests.conftest import rows

NOW = 2_000_000_000_000_000_000
OLD = NOW - 1_200_000_000_000
INTENT = "fingerprint string, intent string, suggested_name string, intent_group string, category string, confidence string"
STATE = "fingerprint string, path string, size long, mtime_ns long, ord long"


def planned(spark, files, intent=(), state=(), **config):
    f = spark.createDataFrame([(p, p.rsplit("/", 1)[-1], 4, m, fp, bytearray(b"test")) for p, m, fp in files], "path string, name string, size long, mtime_ns long, fingerprint string, content binary")
    return make_plan(f, spark.createDataFrame(list(intent), INTENT), spark.createDataFrame(list(state), STATE), extension_table(spark), Config(**config), NOW)


def test_trust_decides_what_is_analysed(spark):
    files = [("quarterly-report.txt", OLD, "f1"), ("a1b2c3d4e5f60718.txt", OLD, "f2"), ("setup.dmg", OLD, "f3")]
    assert rows(planned(spark, files, trust=True).analysis, "source", "analysis_depth") == [("a1b2c3d4e5f60718.txt", "full")]
    assert rows(planned(spark, files, trust=False).analysis, "source", "analysis_depth", "name_hint") == [("a1b2c3d4e5f60718.txt", "full", ""), ("quarterly-report.txt", "targeted", "quarterly-report")]
    assert planned(spark, files, allow_rename=False).analysis.count() == 0


def test_suggestions_are_clipped_and_dated(spark):
    told = [("f1", "contract", "a very long suggested summary.txt", "group name too long", None, "high")]
    m = planned(spark, [("abcdef1234567890.txt", OLD, "f1")], told).moves.head()
    assert m["new_name"] == "330518-a very long sug.txt" and m["intent_group"] == "group na" and m["status"] == "planned"
    low = [(*told[0][:5], "low")]
    p = planned(spark, [("abcdef1234567890.txt", OLD, "f1")], low)
    assert p.moves.head()["new_name"] == "abcdef1234567890.txt" and p.analysis.count() == 0
    off = planned(spark, [("abcdef1234567890.txt", OLD, "f1")], told, allow_rename=False)
    assert off.moves.head()["new_name"] == "abcdef1234567890.txt"


def test_private_hidden_recent(spark):
    files = [("secret-note.txt", OLD, "f1"), ("private-folder/in.txt", OLD, "f2"), (".hid.txt", OLD, "f3"), ("x.crdownload", OLD, "f4"), ("new.txt", NOW - 1, "f5")]
    told = [("f1", "x", "other name.txt", "", None, "high")]
    p = planned(spark, files, told, private=("secret", "private-folder"))
    assert rows(p.skipped) == [(".hid.txt", "hidden"), ("new.txt", "recent"), ("private-folder/in.txt", "private folder"), ("x.crdownload", "incomplete")]
    assert p.moves.head()["new_name"] == "secret-note.txt"


def test_changed_versions_and_conflicts(spark):
    files = [("文档资料/report.txt", OLD, "new"), ("same.txt", OLD, "f2"), ("文档资料/same.txt", OLD, "f3"), ("a/twin.txt", OLD, "f4"), ("b/twin.txt", OLD, "f5")]
    p = planned(spark, files, state=[("old", "文档资料/report.txt", 9, OLD, 1)])
    assert rows(p.analysis, "source", "analysis_depth", "previous_fingerprint") == [("文档资料/report.txt", "diff", "old")]
    got = {r["source"]: (r["status"], r["place"]) for r in p.moves.collect()}
    assert got == {"same.txt": ("conflict", 1), "a/twin.txt": ("planned", 1), "b/twin.txt": ("planned", 2)}
    assert ("文档资料/same.txt", "settled") in rows(p.skipped)


def test_queue(spark):
    events = spark.createDataFrame([("a", 1, "pending"), ("a", 2, "running"), ("a", 3, "failed"), ("b", 4, "pending"), ("c", 5, "running")], "job string, seq long, status string").withColumn("ts", F.timestamp_seconds(F.col("seq")))
    now = jobs.latest(events)
    assert rows(now, "job", "status", "attempts") == [("a", "failed", 1), ("b", "pending", 0), ("c", "running", 1)]
    assert rows(jobs.summary(now)) == [(3, 1, 2, "running")] and rows(jobs.summary(now.limit(0))) == [(0, 0, 0, "completed")]
    assert rows(jobs.claimed(now, 50)) == [("b", 1)]
    assert rows(jobs.expired(now, F.timestamp_seconds(F.lit(3600))), "job") == [("c",)]


def test_transitions(spark):
    r = spark.createDataFrame([("ok", "completed", 1, 5, 1, 5, 1), ("gone", "completed", 1, 5, 1, None, None), ("again", "failed", 1, 5, 1, 5, 1), ("over", "failed", 2, 5, 1, 5, 1)], "job string, status string, attempts int, size int, mtime_ns int, now_size int, now_mtime_ns int")
    assert rows(jobs.completed(r), "job", "next_status") == [("again", "pending"), ("gone", "stale"), ("ok", "completed"), ("over", "failed")]
    assert transition("pending", 0, "running") == ("running", 1) and transition("running", 1, "failed") == ("pending", 1) and transition("running", 2, "failed") == ("failed", 2)


def test_attempts_are_ordered_as_numbers(spark):
    a = spark.createDataFrame([("j", 2, "two"), ("j", 10, "ten")], "job string, attempt int, intent string")
    assert rows(jobs.last_attempts(a)) == [("j", 10, "ten")]


def test_stream_of_jobs(spark, tmp_path):
    events = [("a", 1, "running", 0), ("a", 2, "failed", 60), ("a", 3, "running", 120), ("b", 4, "running", 0)]
    df = spark.createDataFrame(events, "job string, seq long, status string, s long").select("job", "seq", "status", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = job_states(stream).writeStream.format("memory").queryName("job_states").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("job_states")) == [("a", 1, "running", 1), ("a", 2, "pending", 1), ("a", 3, "running", 2), ("b", 4, "running", 1)]


def test_history_round_trip(spark):
    items = spark.createDataFrame([("log", 1, "t1", 1, "已移动", "a|b", "c", "r\nn", "x"), ("log", 2, "t2", 1, "s", "", "d", "", "y")], "log string, run int, run_at string, ord int, status string, source string, destination string, rename string, reason string")
    got = rows(history.parse(history.log_lines(items)), "run", "run_at", "source", "rename")
    assert got == [(1, "t1", "a|b", "r n"), (2, "t2", "", "")]
    noise = spark.createDataFrame([("l", k, t) for k, t in enumerate(["| 1 | 2 | 3 | 4 | 5 |", "## r", "| 状态 |", "|---|", "| 1 | 2 | 3 | 4 | 5 | 6 |", "", "| a | b |", "text", "| 1 | 2 | 3 | 4 | 5 |", "## empty"])], "log string, line_no int, line string")
    assert rows(history.parse(noise), "run", "ord", "status", "reason") == [(1, 1, "1", "5")]


def test_capabilities(spark):
    f = spark.createDataFrame([("a.mp4",), ("b.mp3",), ("c.png",), ("d.pdf",), ("e.txt",)], "name string")
    assert capability.needs(f, {}).head()["missing"] == ["faster_whisper", "keyframes", "paddle", "paddleocr", "pdf"]
    assert capability.needs(f.filter("name = 'a.mp4'"), {"imageio_ffmpeg": True}).head()["ready"]
    a = capability.assessment(f.filter("name = 'c.png'"), {}).head()
    assert (a["requirements_status"], a["required"]) == ("conditional-only", [])
    assert capability.media_gate(f.filter("name = 'e.txt'"), {}, False).head()[0] == "open"


def test_commit(spark, tmp_path):
    for name in ("a.txt", "b.txt", "c.txt", "文档资料/b.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    moves = spark.createDataFrame([("a.txt", "文档资料/a.txt", "文档资料", "", "planned", 5, 1), ("b.txt", "文档资料/b.txt", "文档资料", "", "planned", 5, 1), ("c.txt", "../c.txt", "文档资料", "", "planned", 5, 1)], "source string, destination string, category string, intent_group string, status string, size long, mtime_ns long")
    now = spark.createDataFrame([("a.txt", 5, 1), ("b.txt", 5, 1), ("c.txt", 5, 1), ("文档资料/b.txt", 5, 1)], "path string, size long, mtime_ns long")
    decided = commit.decisions(moves, now, True, True)
    assert [d for *_, d in rows(decided)] == ["move", "skipped: destination exists", "failed: folder"]
    assert [r for *_, r in commit.carry_out(decided, str(tmp_path))][0] == "would move" and (tmp_path / "a.txt").exists()
    commit.carry_out(decided, str(tmp_path), dry_run=False)
    assert (tmp_path / "文档资料/a.txt").read_text() == "a.txt" and (tmp_path / "文档资料/b.txt").read_text() == "文档资料/b.txt" and (tmp_path / "c.txt").exists()
    with pytest.raises(ValueError, match="configuration"):
        commit.check_plan({"root": str(tmp_path), "config_digest": "x"}, str(tmp_path), config_digest({"a": 1}), 0)


def test_report_and_sync(spark):
    facts = spark.createDataFrame([("图片/<a>.png", "old.png", "<a>.png", "1.00 KB")], "path string, original string, current string, human_size string")
    items = spark.createDataFrame([(1, "t", 1, "s", "<src>", "d", "r", "x")], "run int, run_at string, ord int, status string, source string, destination string, rename string, reason string")
    page = report.html_page("Report", facts, items)
    assert "&lt;a&gt;.png" in page and "<src>" not in page and "1 runs, 1 changes, 1 files" in page
    left = spark.createDataFrame([("a", "1"), ("b", "2"), ("__pycache__/x", "3")], "path string, digest string")
    right = spark.createDataFrame([("a", "1"), ("b", "other"), ("old", "4"), ("README.md", "5")], "path string, digest string")
    assert rows(sync.tree_changes(left, right)) == [("b", "update"), ("old", "remove")]


def test_the_page_holds_all_files_and_items(spark):
    n = 100_001
    facts = spark.range(n).selectExpr("format_string('d%d/f%06d', id % 3, id) as path", "'o' as original", "'1 B' as human_size")
    items = spark.range(n).selectExpr("format_string('%06d', id) as run", "'t' as run_at", "0 as ord", "'s' as status", "'a' as source", "'b' as destination", "'' as rename", "'' as reason")
    page = report.html_page("Report", facts, items)
    assert f"<p>{n} runs, {n} changes, {n} files</p>" in page and "d2/f099998" in page and page.count("<li ") == n
