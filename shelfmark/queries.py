"""The registered queries over the derived views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import views as v
from shelfmark.dims import extension_table
from shelfmark.functions import naming, sampling
from shelfmark.functions.cleaning import clean_text
from shelfmark.functions.hashing import folder_fingerprint
from shelfmark.functions.unicode import nfkc
from shelfmark.operators import capability, classify, commit, evidence, filters, history, jobs, report, sync
from shelfmark.plans.planner import Config, Plan, make_plan, plan_folders, with_caches
from shelfmark.sources import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PRIVATE = list(v.PRIVATE)
NONE_AVAILABLE: dict[str, bool] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _plan(spark: SparkSession, sf_dir: str, config: Config | None = None) -> Plan:
    f = v.files(spark, sf_dir)
    return make_plan(f.select("path", "name", "size", "mtime_ns", "fingerprint", "content"), v.intent(spark, sf_dir, f), v.state(spark, sf_dir, f), extension_table(spark), config or Config(private=v.PRIVATE), v.NOW_NS)


@query
def plan_moves(spark, sf_dir):
    return _plan(spark, sf_dir).moves.drop("size", "mtime_ns", "original_name")


@query
def plan_skipped(spark, sf_dir):
    return _plan(spark, sf_dir).skipped


@query
def analysis_queue(spark, sf_dir):
    return _plan(spark, sf_dir).analysis


@query
def analysis_queue_distrust(spark, sf_dir):
    return _plan(spark, sf_dir, Config(trust=False, private=v.PRIVATE)).analysis.groupBy("analysis_depth", "cache_status", "method_required").agg(F.count("*").alias("files"))


@query
def plan_conflicts(spark, sf_dir):
    return _plan(spark, sf_dir).moves.filter("place > 1").select("source", "destination", "place")


@query
def plan_summary(spark, sf_dir):
    return _plan(spark, sf_dir).moves.groupBy("status").agg(F.count("*").alias("moves"), F.count_if("renamed").alias("renames"))


@query
def folder_plan(spark, sf_dir):
    f = v.files(spark, sf_dir, fingerprint=False).filter("dir <> ''").select(F.substring_index("dir", "/", 1).alias("path")).filter("path not in ('图片') and not startswith(path, '.')").distinct()
    f = f.withColumn("fingerprint", folder_fingerprint(F.col("path")))
    cache = f.filter("path like 'b%'").select("fingerprint", F.lit("trip").alias("intent"), F.concat(F.lit("trip to "), "path").alias("suggested_name"), F.lit("high").alias("confidence"))
    return plan_folders(f, cache, Config())[0]


@query
def classify_by_extension(spark, sf_dir):
    return classify.classify(v.files(spark, sf_dir, fingerprint=False).select("path", "name"), extension_table(spark)).drop("name")


@query
def classify_with_content(spark, sf_dir):
    return classify.classify(v.files(spark, sf_dir, fingerprint=False).select("path", "name", "content"), extension_table(spark), "content").select("path", "category", "reason")


@query
def category_counts(spark, sf_dir):
    return classify.category_counts(classify.classify(v.files(spark, sf_dir, fingerprint=False).select("path", "name"), extension_table(spark)))


@query
def hidden_private_filter(spark, sf_dir):
    kept, _ = filters.eligible(v.files(spark, sf_dir, fingerprint=False).select("path", "name", "mtime_ns"), PRIVATE, True, v.NOW_NS, 600)
    return kept.select("path", "private")


@query
def skip_reasons(spark, sf_dir):
    return filters.eligible(v.files(spark, sf_dir, fingerprint=False).select("path", "name", "mtime_ns"), PRIVATE, False, v.NOW_NS, 600)[1]


@query
def recent_filter(spark, sf_dir):
    f = v.files(spark, sf_dir, fingerprint=False)
    return f.select("path", filters.age_reason(F.col("name"), F.col("mtime_ns"), v.NOW_NS, 600).alias("reason")).filter("reason is not null")


@query
def meaningful_names(spark, sf_dir):
    f = v.files(spark, sf_dir, fingerprint=False)
    names = f.select("doc_id", F.explode(F.array(naming.stem(F.col("name")), F.left(F.regexp_replace("text", r"\s+", "_"), F.lit(9)))).alias("stem"))
    return names.withColumn("meaningful", naming.is_meaningful(nfkc("stem")))


@query
def sanitize_names(spark, sf_dir):
    t = nfkc(F.left(F.regexp_replace("text", r"\s+", " "), F.lit(40)))
    return v.table(spark, sf_dir, "documents").select("doc_id", naming.clipped(t, 15).alias("name15"), naming.clipped(t, 8).alias("name8"))


@query
def dated_destination(spark, sf_dir):
    i = v.intent(spark, sf_dir).select("path", "suggested_name", "intent_group")
    f = v.files(spark, sf_dir, fingerprint=False).join(i, "path")
    name = naming.dated_name(F.col("name"), nfkc("suggested_name"), F.timestamp_micros(F.floor(F.col("mtime_ns") / 1000)))
    return f.select("path", naming.joined_path(F.lit("图片"), naming.clipped(nfkc("intent_group"), 8), name).alias("destination"))


@query
def content_fingerprint(spark, sf_dir):
    return v.files(spark, sf_dir).select("path", "fingerprint")


@query
def folder_fingerprints(spark, sf_dir):
    return v.files(spark, sf_dir, fingerprint=False).select("dir").distinct().select("dir", folder_fingerprint(F.col("dir")).alias("fingerprint"))


@query
def intent_lookup(spark, sf_dir):
    f = v.files(spark, sf_dir)
    return f.select("path", "fingerprint").join(v.intent(spark, sf_dir, f).select("fingerprint", "intent", "confidence"), "fingerprint", "left")


@query
def changed_versions(spark, sf_dir):
    f = v.files(spark, sf_dir)
    return with_caches(f.select("path", "fingerprint", "size", "mtime_ns"), v.intent(spark, sf_dir, f), v.state(spark, sf_dir, f)).select("path", "state_hit", "changed", "previous_fingerprint")


@query
def even_sample_indexes(spark, sf_dir):
    n = v.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50).cast("int").alias("total"), (F.col("doc_id") % 8).cast("int").alias("count"))
    return n.select("doc_id", F.array_join(sampling.even_indexes(F.col("total"), F.col("count")), ",").alias("indexes"))


@query
def time_samples(spark, sf_dir):
    n = v.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 1.25 + 1).alias("duration"), (F.col("doc_id") % 12).cast("int").alias("count"))
    return n.select("doc_id", F.posexplode(sampling.even_times(F.col("duration"), F.col("count"))).alias("ord", "time"))


@query
def balanced_excerpt(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select("doc_id", sampling.balanced_excerpt(F.lit("text"), F.col("text"), 1000).alias("excerpt"))


@query
def clean_texts(spark, sf_dir):
    return v.table(spark, sf_dir, "pages").select("page_id", clean_text(F.col("html"), 8000).alias("text"))


@query
def text_file_sample(spark, sf_dir):
    f = v.files(spark, sf_dir, fingerprint=False).select("path", F.concat("name", F.lit(".txt")).alias("name"), "content")
    return documents.extracted(f, 1000).select("path", "method", "text", "truncated", "error")


@query
def markup_text(spark, sf_dir):
    text = "try_element_at(xpath(html, '//text()'), 1)"
    return v.table(spark, sf_dir, "pages").select("page_id", F.expr(f"case when html like '<?xml%' then {text} end").alias("first_text"))


@query
def evidence_index(spark, sf_dir):
    e = v.files(spark, sf_dir).select("fingerprint", F.col("path").alias("source"), F.lit("text-sampled").alias("method"), clean_text(F.col("text"), 8000).alias("text"), F.when(F.col("doc_id") % 6 == 0, "unreadable").alias("error"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).alias("frames"))
    return evidence.index(e)


def _versions(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").select("doc_id", "text")
    old = d.select(F.col("doc_id").alias("was"), F.col("text").alias("before"))
    pair = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1)
    return d.withColumn("was", pair).join(old, "was", "left").select("doc_id", "before", F.col("text").alias("after"))


@query
def evidence_diff_status(spark, sf_dir):
    return _versions(spark, sf_dir).select("doc_id", evidence.diff_status(F.col("before"), F.col("after")).alias("diff_status"))


@query
def evidence_line_delta(spark, sf_dir):
    added, removed = evidence.line_delta(F.col("before"), F.col("after"))
    return _versions(spark, sf_dir).select("doc_id", F.size(added).alias("added"), F.size(removed).alias("removed"))


@query
def evidence_unified_diff(spark, sf_dir):
    return _versions(spark, sf_dir).select("doc_id", evidence.unified_diff("before", "after").alias("diff"))


@query
def pending_work(spark, sf_dir):
    f = v.files(spark, sf_dir)
    work = f.select("fingerprint", "path", F.when(F.col("doc_id") % 3 == 0, "completed").otherwise("pending").alias("status"))
    return evidence.still_to_do(work, f.filter("doc_id % 5 = 0")).select("path")


@query
def cacheable_results(spark, sf_dir):
    r = v.files(spark, sf_dir, fingerprint=False).select("path", F.get(F.array(*map(F.lit, ("text-sampled", "unavailable", "unsupported", "installation-required"))), (F.col("doc_id") % 4).cast("int")).alias("method"), F.when(F.col("doc_id") % 8 == 0, "broken").alias("error"))
    return evidence.cacheable(r).select("path", "method")


@query
def media_routes(spark, sf_dir):
    def one(method, text, error):
        return F.struct(method.alias("method"), text.alias("text"), error.alias("error"))

    f, i, no = v.files(spark, sf_dir, fingerprint=False), F.col("doc_id"), F.lit(None).cast("string")
    speech = one(F.when(i % 3 == 0, "installation-required").otherwise("transcription"), F.when(i % 2 == 0, " ").otherwise("words"), F.when(i % 13 == 0, "broken"))
    r = evidence.media_result(capability.kind(F.col("name")), one(F.lit("ocr"), F.lit("seen"), no), speech, one(F.lit("keyframes"), F.lit(""), no))
    return f.select("path", r["method"].alias("method"), r["text"].alias("text")).filter("method is not null")


@query
def route_jobs(spark, sf_dir):
    f = v.files(spark, sf_dir, fingerprint=False)
    return f.select("path", capability.kind(F.col("name")).alias("kind"), capability.route(F.col("name"), naming.is_private(F.col("path"), PRIVATE)).alias("route"))


@query
def kind_counts(spark, sf_dir):
    return capability.kind_counts(v.files(spark, sf_dir, fingerprint=False))


@query
def capability_summary(spark, sf_dir):
    c = capability.needs(v.files(spark, sf_dir, fingerprint=False), {"ffmpeg": True, "ffprobe": True, "paddle": True})
    return c.select(F.array_join("media_kinds", ",").alias("media_kinds"), F.array_join("missing", ",").alias("missing"), "ready")


@query
def plan_assessment(spark, sf_dir):
    a = capability.assessment(v.files(spark, sf_dir, fingerprint=False), NONE_AVAILABLE)
    return a.select("files", F.array_join("required", ",").alias("required"), F.array_join("conditional", ",").alias("conditional"), "requirements_status", "authorization_required")


@query
def media_gate(spark, sf_dir):
    return capability.media_gate(v.files(spark, sf_dir, fingerprint=False), {"faster_whisper": True, "paddleocr": True, "paddle": True}, False)


@query
def job_latest_state(spark, sf_dir):
    return jobs.latest(v.job_events(spark, sf_dir))


@query
def job_status_counts(spark, sf_dir):
    return jobs.status_counts(jobs.latest(v.job_events(spark, sf_dir)))


@query
def run_summary(spark, sf_dir):
    return jobs.summary(jobs.latest(v.job_events(spark, sf_dir)))


@query
def claim_batch(spark, sf_dir):
    return jobs.claimed(jobs.latest(v.job_events(spark, sf_dir)))


@query
def expired_leases(spark, sf_dir):
    return jobs.expired(jobs.latest(v.job_events(spark, sf_dir)), F.expr("timestamp_ntz'2024-01-20 00:00:00'")).select("job", "attempts")


@query
def result_transitions(spark, sf_dir):
    e, i = v.table(spark, sf_dir, "events").filter("event_type in ('purchase', 'error')"), F.col("event_id")
    size = i % 10
    r = e.select(i.alias("job"), F.when(F.col("event_type") == "purchase", "completed").otherwise("failed").alias("status"), (F.col("user_id") % 4).alias("attempts"), size.alias("size"), F.lit(1).alias("mtime_ns"), F.when(i % 5 != 0, F.when(i % 7 == 0, size + 1).otherwise(size)).alias("now_size"), F.lit(1).alias("now_mtime_ns"))
    return jobs.completed(r)


@query
def merge_intents(spark, sf_dir):
    e, i = v.table(spark, sf_dir, "events"), F.col("event_id")
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    todo = e.filter("event_type in ('purchase', 'error', 'view')").select(name(i).alias("job"), F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "unavailable").otherwise("failed").alias("status"), F.concat(F.lit("src/"), i.cast("string")).alias("source"), F.when(i % 6 == 0, name(i - 1)).otherwise("").alias("previous"))
    tries = e.select(i, F.explode(F.array(F.lit(2), F.lit(10))).alias("attempt")).filter("event_id % 2 = 0 or attempt = 2")
    results = tries.select(name(i).alias("job"), "attempt", F.concat(F.lit("try "), F.col("attempt").cast("string")).alias("intent"), F.lit("n").alias("suggested_name"), F.lit("g").alias("intent_group"), F.lit("content").alias("method"), F.when(i % 9 != 0, "high").alias("confidence"), F.when(i % 4 == 0, "no tool").alias("error"))
    no = F.lit(None).cast("string")
    old = e.filter("event_id % 4 = 0").select(name(i).alias("fingerprint"), F.lit("old").alias("source"), F.lit("before").alias("intent"), F.lit("o").alias("suggested_name"), F.lit("g").alias("intent_group"), F.lit("content").alias("method"), F.lit("low").alias("confidence"), no.alias("error"), no.alias("supersedes"))
    return jobs.merged(todo, results, old)


@query
def retire_superseded(spark, sf_dir):
    e, i = v.table(spark, sf_dir, "events"), F.col("event_id")
    return jobs.retired(e.select(i.cast("string").alias("fingerprint"), F.when(i % 5 == 0, (i + 3).cast("string")).alias("supersedes")))


def _decided(spark, sf_dir):
    f = v.files(spark, sf_dir)
    i = F.col("doc_id")
    moves = f.select(F.col("path").alias("source"), F.concat(F.when(i % 9 == 0, "../").otherwise("文档资料/"), F.left("text", F.lit(4)), F.lit(".txt")).alias("destination"), F.when(i % 10 == 0, "misc").otherwise("文档资料").alias("category"), F.lit("").alias("intent_group"), F.when(i % 8 == 1, "conflict").otherwise("planned").alias("status"), "size", "mtime_ns")
    current = f.filter("doc_id % 6 <> 5").select("path", (F.col("size") + F.when(i % 4 == 3, 1).otherwise(0)).alias("size"), "mtime_ns")
    return commit.decisions(moves, current, True, True)


@query
def apply_decisions(spark, sf_dir):
    return _decided(spark, sf_dir)


@query
def stop_on_failure(spark, sf_dir):
    return commit.until_failure(_decided(spark, sf_dir))


@query
def validate_mapping(spark, sf_dir):
    f, i = v.files(spark, sf_dir, fingerprint=False), F.col("doc_id")
    d = F.when(i % 4 == 0, "文档资料/a.txt").when(i % 4 == 1, "图片/../../a.txt").when(i % 4 == 2, F.concat(F.lit("图片/"), "name")).otherwise("图片/组/file2intent.md")
    m = f.select("path", F.col("path").alias("source"), d.alias("destination"), F.when(i % 5 == 0, "misc").when(i % 4 == 0, "文档资料").otherwise("图片").alias("category"), F.when(i % 4 == 3, "组").otherwise("").alias("intent_group"))
    return m.select("path", naming.mapping_error(F.col("source"), F.col("destination"), F.col("category"), F.col("intent_group"), False, False).alias("error"))


@query
def safe_paths(spark, sf_dir):
    p = v.files(spark, sf_dir, fingerprint=False).select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "../").when(F.col("doc_id") % 3 == 1, "./x/../").otherwise("x/"), "path").alias("raw"))
    return commit.safe_paths(p, "raw").select("doc_id", "normal")


@query
def history_parse(spark, sf_dir):
    return history.parse(history.log_lines(v.log_items(spark, sf_dir)))


@query
def history_kpis(spark, sf_dir):
    return history.kpis(history.parse(history.log_lines(v.log_items(spark, sf_dir))))


@query
def history_chronology(spark, sf_dir):
    return report.chronology(history.parse(history.log_lines(v.log_items(spark, sf_dir)))).drop("run")


@query
def markdown_roundtrip(spark, sf_dir):
    c = v.log_items(spark, sf_dir).select("log", "run", "source", "rename")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", naming.markdown_cell(F.col("source")), naming.markdown_cell(F.col("rename"))), F.lit(" |"))
    cells = naming.markdown_cells(line)
    return c.select("log", "run", line.alias("line"), F.get(cells, F.lit(0)).alias("source"), F.get(cells, F.lit(1)).alias("rename"))


@query
def human_sizes(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents")
    n = F.coalesce("n_chars", F.lit(0)) * F.get(F.array(*(F.lit(1024**k) for k in range(4))), (F.col("doc_id") % 4).cast("int"))
    return d.select("doc_id", naming.human_size(n).alias("size"))


@query
def report_files(spark, sf_dir):
    f = v.files(spark, sf_dir)
    moved = f.filter("doc_id % 3 = 0").select(F.concat(F.lit("inbox/from-"), "name").alias("source"), F.col("path").alias("destination"), (F.col("doc_id") % 2 == 0).alias("moved"))
    facts = report.file_facts(f.select("path", "size", "mtime_ns"), report.metadata(v.state(spark, sf_dir, f), moved))
    return facts.withColumn("modified", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss"))


@query
def intent_index(spark, sf_dir):
    f = v.files(spark, sf_dir)
    return report.intent_index(v.intent(spark, sf_dir, f), f.filter("doc_id % 2 = 0").select("fingerprint", F.concat(F.lit("moved/"), "name").alias("path")))


@query
def html_escapes(spark, sf_dir):
    return v.table(spark, sf_dir, "pages").select("page_id", naming.html_text(F.left("html", F.lit(200))).alias("escaped"))


@query
def tree_sync(spark, sf_dir):
    f = v.files(spark, sf_dir, fingerprint=False).select("doc_id", "path", F.sha2("content", 256).alias("digest"))
    right = f.filter("doc_id % 3 <> 0").select(F.when(F.col("doc_id") % 7 == 1, F.concat(F.lit("x-"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 5 == 2, "other").otherwise(F.col("digest")).alias("digest"))
    return sync.tree_changes(f, right)


@query
def boolean_words(spark, sf_dir):
    words = F.array(*map(F.lit, ("yes", " Y", "TRUE", "1", "是", "允许", "no", "n", "False", "0 ", "否", "不允许")))
    d = v.table(spark, sf_dir, "documents").select("doc_id", F.get(words, (F.col("doc_id") % 12).cast("int")).alias("word"))
    return d.select("doc_id", naming.parsed_bool(F.col("word")).alias("value"))


@query
def private_name_lists(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("、", F.lit("b"), F.left(F.coalesce("text", F.lit("")), F.lit(12)), F.lit(" b , a")).alias("list"))
    return d.select("doc_id", F.array_join(naming.private_names(F.col("list")), "|").alias("names"))
