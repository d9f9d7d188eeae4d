"""The registered queries once more, in DuckDB's SQL over the driver's tables."""

from __future__ import annotations

from shelfmark import dims, views


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(values) -> str:
    return "(" + _list(values)[1:-1] + ")"


_FILES = f"""
files AS (
    SELECT *, sha256('v2:' || size || ':' || mtime_ns || ':' || text) AS fingerprint FROM (
        SELECT doc_id, text, name, dir, CASE WHEN dir = '' THEN name ELSE dir || '/' || name END AS path,
               CAST(strlen(text) AS BIGINT) AS size, (doc_id * 61 + {views.EPOCH}) * 1000000000 + 5 AS mtime_ns
        FROM (
            SELECT doc_id, coalesce(text, '') AS text,
                   CASE WHEN doc_id % 11 = 3 THEN '.' ELSE '' END
                   || (['quarterly-report', left(md5(CAST(doc_id AS VARCHAR)), 16), 'IMG_00042', 'secret-note', '季度报告总结', 'readme', '_under'])[1 + doc_id % 7]
                   || '.' || ({_list(views.EXTENSIONS)})[1 + doc_id % 17] AS name,
                   concat_ws('/', nullif(({_list(views.FOLDERS)})[1 + doc_id % 5], ''),
                             CASE WHEN doc_id // 595 > 0 THEN 'b' || (doc_id // 595) END) AS dir
            FROM documents)))"""

_SUFFIX = r"regexp_extract({0}, '^.+(\.[^.]+)$', 1)"


def _suffix(x: str) -> str:
    return _SUFFIX.format(x)


def _stem(x: str) -> str:
    return f"left({x}, length({x}) - length({_suffix(x)}))"


def _clipped(x: str, n: int) -> str:
    def cut(y: str) -> str:
        return rf"regexp_replace(left({y}, {n}), '[ .\-_]+$', '')"

    safe = cut(rf"""trim(regexp_replace({x}, '[\x00-\x1f<>:"/\\|?*]', '-', 'g'), ' .-_')""")
    return f"CASE WHEN lower({safe}) IN {_in(dims.DEVICE_NAMES)} THEN {cut(f'({safe} || {chr(39)}-文件{chr(39)})')} ELSE {safe} END"


def _meaningful(stem: str) -> str:
    s = f"trim({stem}, ' ._-()[]')"
    compact = rf"regexp_replace({s}, '[^\p{{L}}\p{{N}}]', '', 'g')"
    letters = rf"length(regexp_replace({compact}, '[^\p{{L}}]', '', 'g'))"
    digits = rf"length(regexp_replace({compact}, '[^\p{{Nd}}]', '', 'g'))"
    return f"(length({compact}) >= 4 AND NOT regexp_matches({s}, '{dims.MEANINGLESS}') AND {letters} >= 2 AND {letters} * 2 >= {digits})"


# Told again for the suffixes that the views have, so that the table under test isn't its own oracle.
_EXT = "ext(suffix, mapped) AS (VALUES ('.pdf', '文档资料'), ('.epub', '电子书'), ('.png', '图片'), ('.mp4', '视频'), ('.mp3', '音频'), ('.srt', '字幕'), ('.zip', '压缩包'), ('.dmg', '安装包'), ('.ttf', '字体'), ('.py', '代码'), ('.pdb', '代码'))"


def _markers(text: str, markers) -> str:
    return f"list_bool_or(list_transform({_list(markers)}, lambda m: contains({text}, m)))"


def _classified(content: str | None, columns: str, source: str = "files") -> str:
    """category and reason of the rows of source; content: the condition under which texts may be looked at."""
    may = content or "false"
    code = f"({may} AND {_markers('lower(text)', dims.CODE_MARKERS)})"
    doc, conf = f"s IN {_in(dims.DOC_AMBIGUOUS)}", f"s IN {_in(dims.CONFIG_AMBIGUOUS)}"
    dev = " OR ".join(f"starts_with(n, '{w}')" for w in dims.DEVELOPMENT_DOCS)
    cases = [
        (f"n IN {_in(dims.SPECIAL_CODE_NAMES)} OR starts_with(n, 'dockerfile.') OR starts_with(n, 'makefile.')", "代码", "development file name"),
        (f"s = '.ts' AND {may} AND strlen(text) > 188 AND substring(text, 1, 1) = 'G' AND substring(hex(text), 377, 2) = '47'", "视频", "transport stream"),
        (f"s = '.ts' AND {code}", "代码", "code in content"),
        ("s = '.ts'", "其它", "ambiguous extension"),
        (f"s = '.m' AND {may} AND {_markers('text', dims.OBJECTIVE_C)}", "代码", "code in content"),
        ("s = '.m'", "其它", "ambiguous extension"),
        (f"{doc} AND ({dev})", "代码", "development document"),
        (f"{doc} AND {code}", "代码", "code in content"),
        (doc, "文档资料", "markup document"),
        (f"{conf} AND {code}", "代码", "code in content"),
        (conf, "其它", "configuration or data"),
        ("mapped IS NOT NULL", "@", "@"),
        (f"{may} AND starts_with(text, '%PDF')", "文档资料", "PDF content"),
        (f"{may} AND starts_with(text, 'GIF8')", "图片", "image content"),
        (f"{may} AND starts_with(text, '#!')", "代码", "script content"),
    ]
    pick = lambda k: "CASE " + " ".join(f"WHEN {c} THEN " + (("mapped", "'extension ' || s")[k] if r[0] == "@" else f"'{r[k]}'") for c, *r in cases) + f" ELSE '{('其它', 'unknown')[k]}' END"
    return f"SELECT {columns}, {pick(0)} AS category, {pick(1)} AS reason FROM (SELECT *, lower(name) AS n, lower({_suffix('name')}) AS s FROM {source}) LEFT JOIN ext ON s = suffix"


def _private(path: str) -> str:
    return f"list_bool_or(list_transform({_list(views.PRIVATE)}, lambda p: contains(lower({path}), p)))"


def _age(now: int = views.NOW_NS) -> str:
    return f"CASE WHEN lower({_suffix('name')}) IN {_in(dims.INCOMPLETE)} THEN 'incomplete' WHEN ({now} - mtime_ns) / 1e9 < 600 THEN 'recent' END"


def _skip(include_existing: bool) -> str:
    existing = "" if include_existing else f"WHEN dir <> '' THEN CASE WHEN split_part(path, '/', 1) IN {_in(dims.CATEGORIES)} THEN '-' ELSE 'existing folder' END"
    return rf"""coalesce(CASE WHEN name IN {_in(dims.GENERATED)} THEN '-' WHEN regexp_matches(path, '(^|/)\.') THEN CASE WHEN dir = '' THEN 'hidden' ELSE '-' END
        {existing} WHEN dir <> '' AND {_private('dir')} THEN 'private folder' END, {_age()})"""


_FLAT = r"regexp_replace(text, '\s+', ' ', 'g')"
_INTENT = f"""
intent AS (
    SELECT fingerprint, path, path AS source, 'about ' || left({_FLAT}, 9) AS intent, left({_FLAT}, 30) AS suggested_name,
           substring({_FLAT}, 5, 12) AS intent_group, CASE WHEN doc_id % 3 = 0 THEN '文档资料' END AS category,
           CASE WHEN quality = 1 AND toxic = 0 THEN 'high' WHEN quality = 1 THEN 'medium' ELSE 'low' END AS confidence, 'content' AS method
    FROM files JOIN labels USING (doc_id))"""
_STATE = """
state AS (
    SELECT sha256('v2:' || old || ':' || mtime_ns || ':' || text) AS fingerprint, path, 'was-' || name AS original_name, old AS size, mtime_ns, doc_id AS ord
    FROM (SELECT *, size + CASE WHEN doc_id % 8 = 4 THEN 1 ELSE 0 END AS old FROM files WHERE doc_id % 4 = 0))"""
_CACHED = """
cached AS (
    SELECT f.*, i.confidence, i.intent, i.suggested_name AS told_name, i.intent_group AS told_group, i.category AS told_category,
           h.fingerprint IS NOT NULL AS state_hit,
           (s.fingerprint IS NOT NULL AND h.fingerprint IS NULL AND (s.size <> f.size OR s.mtime_ns <> f.mtime_ns)) AS changed,
           CASE WHEN s.fingerprint <> f.fingerprint THEN s.fingerprint ELSE '' END AS previous_fingerprint
    FROM kept f LEFT JOIN intent i ON f.fingerprint = i.fingerprint
    LEFT JOIN (SELECT DISTINCT fingerprint FROM state) h ON f.fingerprint = h.fingerprint
    LEFT JOIN (SELECT path, arg_max(fingerprint, ord) AS fingerprint, arg_max(size, ord) AS size, arg_max(mtime_ns, ord) AS mtime_ns FROM state GROUP BY path) s ON f.path = s.path)"""


def _planned(trust: bool) -> str:
    """WITH clauses up to `moving`: the files of the plan with their destinations."""
    doubt = "true" if not trust else f"(changed OR private OR NOT {_meaningful(_stem('name'))})"
    usable = "coalesce(confidence IN ('high', 'medium'), false) AND NOT private"
    return f"""
WITH {_FILES}, {_EXT}, {_INTENT}, {_STATE},
kept AS (SELECT *, {_private('path')} AS private FROM files WHERE {_skip(True)} IS NULL), {_CACHED},
organised AS (SELECT *, state_hit OR (contains(path, '/') AND split_part(path, '/', 1) IN {_in(dims.CATEGORIES)} AND NOT changed) AS already_organized FROM cached),
told AS ({_classified('(NOT private AND NOT already_organized)', '*', 'organised')}),
need AS (SELECT * REPLACE (CASE WHEN {usable} AND told_category IS NOT NULL THEN told_category ELSE category END AS category,
                           CASE WHEN {usable} AND told_category IS NOT NULL THEN 'intent: ' || intent ELSE reason END AS reason),
         NOT already_organized AND category NOT IN ('安装包', '压缩包') AND {doubt} AND confidence IS NULL AS needed,
         CASE WHEN {usable} THEN told_name ELSE '' END AS suggested,
         CASE WHEN confidence IN ('high', 'medium') THEN {_clipped('told_group', 8)} ELSE '' END AS intent_group, {_meaningful(_stem('name'))} AS meaningful
         FROM told),
named AS (SELECT *, CASE WHEN suggested = '' OR {_clipped(_stem('suggested'), 15)} = '' THEN name
                    ELSE strftime(make_timestamp(mtime_ns // 1000), '%y%m%d') || '-' || {_clipped(_stem('suggested'), 15)} || {_suffix('name')} END AS new_name FROM need),
placed AS (SELECT *, concat_ws('/', category, nullif(intent_group, ''), new_name) AS destination FROM named),
moving AS (SELECT p.*, CASE WHEN needed THEN 'analysis-required' WHEN t.path IS NOT NULL THEN 'conflict' ELSE 'planned' END AS status,
                  CAST(row_number() OVER (PARTITION BY destination ORDER BY lower(p.path), p.path) AS INTEGER) AS place
           FROM placed p LEFT JOIN (SELECT DISTINCT path FROM files) t ON p.destination = t.path WHERE p.path <> destination)"""


def _analysis(trust: bool) -> str:
    depth = "CASE WHEN private THEN 'filename-only' WHEN changed THEN 'diff' " + ("" if trust else "WHEN meaningful THEN 'targeted' ") + "ELSE 'full' END"
    return f"""SELECT path AS source, fingerprint, previous_fingerprint, CASE WHEN changed THEN 'modified' ELSE 'new' END AS cache_status, category AS media_category,
        CASE WHEN private THEN 'filename-only' ELSE 'content' END AS method_required, CASE WHEN private OR meaningful THEN {_stem('name')} ELSE '' END AS name_hint,
        {depth} AS analysis_depth FROM placed WHERE needed"""


def _among(names: str) -> str:
    return f"s IN {_in('.' + x for x in names.split())}"


_KIND = f"CASE WHEN {_among(dims.MEDIA_VIDEO)} THEN 'video' WHEN {_among(dims.MEDIA_AUDIO)} THEN 'audio' WHEN {_among(dims.MEDIA_IMAGE)} THEN 'image' WHEN s = '.pdf' THEN 'pdf' ELSE 'document' END"
_KINDS = f"kinds AS (SELECT *, {_KIND} AS kind FROM (SELECT *, lower({_suffix('name')}) AS s FROM files))"


def _clean(x: str, n: int) -> str:
    y = rf"regexp_replace(regexp_replace(regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f]+', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"left(trim({y}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), {n})"


_VERSIONS = """versions AS (SELECT d.doc_id, o.text AS before, d.text AS after FROM documents d
    LEFT JOIN documents o ON o.doc_id = CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id ELSE d.doc_id + 1 END)"""
_LINES = "CASE WHEN coalesce({0}, '') = '' THEN [] ELSE string_split(regexp_replace({0}, '\\n$', ''), chr(10)) END"
_EVENTS = """job_events AS (SELECT user_id AS job, event_id AS seq, ts,
    CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'stale' END AS status FROM events),
latest AS (SELECT job, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(ts, seq) AS ts, count(*) FILTER (status = 'running') AS attempts FROM job_events GROUP BY job)"""
_TERMINAL = "('completed', 'failed', 'unavailable', 'stale', 'skipped')"
_ITEMS = """items AS (SELECT conv_id AS log, turn AS run, 'run ' || turn AS run_at, role AS status, trim(left(flat, 40)) AS source, trim(substring(flat, 41, 40)) AS destination,
    'a | b' AS rename, trim(right(flat, 30)) AS reason FROM (SELECT *, replace(coalesce(text, ''), chr(10), ' ') AS flat FROM conversations))"""


_DECISIONS = f"""
WITH {_FILES},
moves AS (SELECT path AS source, CASE WHEN doc_id % 9 = 0 THEN '../' ELSE '文档资料/' END || left(text, 4) || '.txt' AS destination,
                 CASE WHEN doc_id % 10 = 0 THEN 'misc' ELSE '文档资料' END AS category, CASE WHEN doc_id % 8 = 1 THEN 'conflict' ELSE 'planned' END AS status, size, mtime_ns FROM files),
now AS (SELECT path, size + CASE WHEN doc_id % 4 = 3 THEN 1 ELSE 0 END AS size, mtime_ns FROM files WHERE doc_id % 6 <> 5),
ruled AS (SELECT m.source, m.destination, CASE
    WHEN category = 'misc' THEN 'failed: category'
    WHEN regexp_extract(m.destination, '^(.*)/[^/]*$', 1) <> category THEN 'failed: folder'
    WHEN m.status <> 'planned' THEN 'skipped: not planned' WHEN n.path IS NULL THEN 'skipped: no source'
    WHEN t.path IS NOT NULL THEN 'skipped: destination exists' WHEN n.size <> m.size THEN 'skipped: changed' END AS decision
    FROM moves m LEFT JOIN now n ON m.source = n.path LEFT JOIN now t ON m.destination = t.path),
decided AS (SELECT source, destination, coalesce(decision, CASE WHEN row_number() OVER (PARTITION BY destination, decision IS NULL ORDER BY source) > 1 THEN 'skipped: destination exists' ELSE 'move' END) AS decision FROM ruled)"""

SQL: dict[str, str] = {
    "plan_moves": f"{_planned(True)} SELECT path AS source, destination, new_name, name <> new_name AS renamed, intent_group, category, reason, status, private, already_organized, fingerprint, place FROM moving",
    "plan_skipped": f"{_planned(True)} SELECT path AS source, {_skip(True)} AS reason FROM files WHERE {_skip(True)} <> '-' UNION ALL SELECT path, 'settled' FROM placed WHERE path = destination",
    "analysis_queue": f"{_planned(True)} {_analysis(True)}",
    "analysis_queue_distrust": f"{_planned(False)} SELECT analysis_depth, cache_status, method_required, count(*) AS files FROM ({_analysis(False)}) GROUP BY ALL",
    "plan_conflicts": f"{_planned(True)} SELECT path AS source, destination, place FROM moving WHERE place > 1",
    "plan_summary": f"{_planned(True)} SELECT status, count(*) AS moves, count(*) FILTER (name <> new_name) AS renames FROM moving GROUP BY status",
    "folder_plan": f"WITH {_FILES}, f AS (SELECT DISTINCT split_part(dir, '/', 1) AS path FROM files WHERE dir <> ''), g AS (SELECT path, 'trip to ' || path AS told FROM f WHERE path <> '图片' AND NOT starts_with(path, '.') AND path LIKE 'b%') SELECT path AS source, {_clipped('told', 8)} AS destination, CASE WHEN {_clipped('told', 8)} IN (SELECT path FROM f) THEN 'conflict' ELSE 'planned' END AS status, sha256('dir-v2:' || lower(path)) AS fingerprint FROM g",
    "classify_by_extension": f"WITH {_FILES}, {_EXT} {_classified(None, 'path')}",
    "classify_with_content": f"WITH {_FILES}, {_EXT} {_classified('true', 'path')}",
    "category_counts": f"WITH {_FILES}, {_EXT}, c AS ({_classified(None, 'path')}) SELECT category, count(*) AS files FROM c GROUP BY category",
    "hidden_private_filter": f"WITH {_FILES} SELECT path, {_private('path')} AS private FROM files WHERE {_skip(True)} IS NULL",
    "skip_reasons": f"WITH {_FILES} SELECT path AS source, {_skip(False)} AS reason FROM files WHERE {_skip(False)} <> '-'",
    "recent_filter": f"WITH {_FILES} SELECT path, {_age()} AS reason FROM files WHERE {_age()} IS NOT NULL",
    "meaningful_names": rf"WITH {_FILES}, n AS (SELECT doc_id, {_stem('name')} AS stem FROM files UNION ALL SELECT doc_id, left(regexp_replace(text, '\s+', '_', 'g'), 9) FROM files) SELECT doc_id, stem, {_meaningful('stem')} AS meaningful FROM n",
    "sanitize_names": rf"WITH t AS (SELECT doc_id, left(regexp_replace(text, '\s+', ' ', 'g'), 40) AS t FROM documents) SELECT doc_id, {_clipped('t', 15)} AS name15, {_clipped('t', 8)} AS name8 FROM t",
    "dated_destination": f"WITH {_FILES}, {_INTENT} SELECT path, concat_ws('/', '图片', nullif({_clipped('intent_group', 8)}, ''), CASE WHEN {_clipped(_stem('suggested_name'), 15)} = '' THEN name ELSE strftime(make_timestamp(mtime_ns // 1000), '%y%m%d') || '-' || {_clipped(_stem('suggested_name'), 15)} || {_suffix('name')} END) AS destination FROM intent JOIN (SELECT path, name, mtime_ns FROM files) USING (path)",
    "content_fingerprint": f"WITH {_FILES} SELECT path, fingerprint FROM files",
    "folder_fingerprints": f"WITH {_FILES} SELECT DISTINCT dir, sha256('dir-v2:' || lower(dir)) AS fingerprint FROM files",
    "intent_lookup": f"WITH {_FILES}, {_INTENT} SELECT f.path, f.fingerprint, i.intent, i.confidence FROM files f LEFT JOIN intent i ON f.fingerprint = i.fingerprint",
    "changed_versions": f"WITH {_FILES}, {_INTENT}, {_STATE}, kept AS (SELECT * FROM files), {_CACHED} SELECT path, state_hit, changed, previous_fingerprint FROM cached",
    "even_sample_indexes": "SELECT doc_id, array_to_string(CASE WHEN t <= 0 OR c <= 0 THEN [] WHEN t <= c THEN range(t) WHEN c = 1 THEN [0] ELSE list_sort(list_distinct(list_transform(range(c), lambda i: CAST(round_even(i * (t - 1) / (c - 1), 0) AS BIGINT)))) END, ',') AS indexes FROM (SELECT doc_id, doc_id % 50 AS t, doc_id % 8 AS c FROM documents)",
    "time_samples": "SELECT doc_id, CAST(i AS INTEGER) AS ord, CASE WHEN n = 1 THEN round(d * 0.5, 6) ELSE round(d * (0.05 + CAST(0.9 AS DOUBLE) * i / (n - 1)), 6) END AS time FROM (SELECT doc_id, CAST(doc_id AS DOUBLE) * 1.25 + 1 AS d, least(greatest(doc_id % 12, 1), 9) AS n, unnest(range(least(greatest(doc_id % 12, 1), 9))) AS i FROM documents)",
    "balanced_excerpt": rf"WITH b AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS t, 992 AS budget, (992 - 6) // 3 AS third FROM documents), e AS (SELECT doc_id, t, '[text]' || chr(10) || CASE WHEN length(t) <= budget THEN t ELSE left(t, third) || chr(10) || '…' || chr(10) || substring(t, 1 + greatest(0, length(t) // 2 - third // 2), third) || chr(10) || '…' || chr(10) || right(t, third) END AS x FROM b) SELECT doc_id, CASE WHEN t = '' THEN '' ELSE {_clean('x', 1000)} END AS excerpt FROM e",
    "clean_texts": f"SELECT page_id, {_clean('html', 8000)} AS text FROM pages",
    "evidence_index": f"WITH {_FILES} SELECT fingerprint, path AS source, 'text-sampled' AS method, CAST(length({_clean('text', 8000)}) AS INTEGER) AS characters, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS frames, CASE WHEN doc_id % 6 = 0 THEN 'unreadable' END AS error FROM files",
    "evidence_diff_status": f"WITH {_VERSIONS} SELECT doc_id, CASE WHEN before IS NULL THEN 'previous-evidence-unavailable' WHEN {_LINES.format('before')} = {_LINES.format('after')} THEN 'sample-unchanged' ELSE 'changed' END AS diff_status FROM versions",
    "evidence_line_delta": f"WITH {_VERSIONS}, l AS (SELECT doc_id, {_LINES.format('before')} AS a, {_LINES.format('after')} AS b FROM versions) SELECT doc_id, CAST(len(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))) AS INTEGER) AS added, CAST(len(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS INTEGER) AS removed FROM l",
    "pending_work": f"WITH {_FILES} SELECT path FROM files WHERE doc_id % 3 <> 0 AND fingerprint NOT IN (SELECT fingerprint FROM files WHERE doc_id % 5 = 0)",
    "cacheable_results": f"WITH {_FILES} SELECT path, 'text-sampled' AS method FROM files WHERE doc_id % 4 = 0 AND doc_id % 8 <> 0",
    "media_routes": f"WITH {_FILES}, {_KINDS}, m AS (SELECT path, kind, doc_id, doc_id % 3 = 0 AS off, CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE 'words' END AS t FROM kinds WHERE kind IN ('image', 'audio', 'video')) SELECT path, CASE WHEN kind = 'image' THEN 'ocr' WHEN kind = 'audio' OR (NOT off AND t = 'words' AND doc_id % 13 <> 0) THEN CASE WHEN off THEN 'installation-required' ELSE 'transcription' END ELSE 'keyframes' END AS method, CASE WHEN kind = 'image' THEN 'seen' WHEN kind = 'audio' OR (NOT off AND t = 'words' AND doc_id % 13 <> 0) THEN t ELSE '' END AS text FROM m",
    "route_jobs": f"WITH {_FILES}, {_KINDS} SELECT path, kind, CASE WHEN {_private('path')} THEN 'filename-only' WHEN {_among(dims.READABLE)} THEN 'document' WHEN kind = 'image' THEN 'image' WHEN kind IN ('video', 'audio') THEN 'media' ELSE 'unavailable' END AS route FROM kinds",
    "kind_counts": f"WITH {_FILES}, {_KINDS} SELECT kind, count(*) AS files FROM kinds GROUP BY kind",
    "capability_summary": f"WITH {_FILES}, {_KINDS}, w AS (SELECT DISTINCT kind, unnest(CASE kind WHEN 'audio' THEN ['faster_whisper'] WHEN 'image' THEN ['paddleocr'] WHEN 'pdf' THEN ['pdf'] ELSE [NULL] END) AS need FROM kinds) SELECT string_agg(DISTINCT CASE WHEN kind IN ('video', 'audio', 'image') THEN kind END, ',' ORDER BY CASE WHEN kind IN ('video', 'audio', 'image') THEN kind END) AS media_kinds, coalesce(string_agg(DISTINCT need, ',' ORDER BY need), '') AS missing, count(need) = 0 AS ready FROM w",
    "plan_assessment": f"WITH {_FILES}, {_KINDS}, n AS (SELECT kind, CASE kind WHEN 'video' THEN 'imageio-ffmpeg==0.6.0' WHEN 'audio' THEN 'faster-whisper==1.2.1' WHEN 'pdf' THEN 'pypdf==6.1.1' END AS r, CASE WHEN kind = 'image' THEN 'paddleocr==3.7.0' END AS c FROM kinds) SELECT count(*) AS files, coalesce(string_agg(DISTINCT r, ',' ORDER BY r), '') AS required, coalesce(string_agg(DISTINCT c, ',' ORDER BY c), '') AS conditional, CASE WHEN count(r) = 0 AND count(c) = 0 THEN 'not-needed' WHEN count(DISTINCT r) = 4 THEN 'full-install-required' WHEN count(r) > 0 THEN 'minimal-install-required' ELSE 'conditional-only' END AS requirements_status, count(r) > 0 AS authorization_required FROM n",
    "media_gate": f"WITH {_FILES}, {_KINDS} SELECT CASE WHEN count(*) = 0 THEN 'open' ELSE 'confirmation-required' END AS gate FROM kinds WHERE kind IN ('video', 'audio', 'image')",
    "job_latest_state": f"WITH {_EVENTS} SELECT * FROM latest",
    "job_status_counts": f"WITH {_EVENTS} SELECT status, count(*) AS jobs FROM latest GROUP BY status",
    "run_summary": f"WITH {_EVENTS}, s AS (SELECT count(*) AS total, count(*) FILTER (status IN {_TERMINAL}) AS done FROM latest) SELECT total, done, total - done AS remaining, CASE WHEN total = done THEN 'completed' ELSE 'running' END AS status FROM s",
    "claim_batch": f"WITH {_EVENTS} SELECT job, attempts + 1 AS attempts FROM latest WHERE status = 'pending' ORDER BY job LIMIT 12",
    "expired_leases": f"WITH {_EVENTS} SELECT job, attempts FROM latest WHERE status = 'running' AND ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 30 MINUTE",
    "result_transitions": "WITH r AS (SELECT event_id AS job, user_id % 4 AS attempts, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'stale' ELSE 'completed' END AS result FROM events WHERE event_type IN ('purchase', 'error')) SELECT job, result, CASE WHEN result = 'failed' AND attempts < 2 THEN 'pending' ELSE result END AS next_status, result = 'failed' AND attempts < 2 AS will_retry FROM r",
    "merge_intents": """
        WITH j AS (SELECT event_id AS i, 'f' || event_id AS job, event_type, 'src/' || event_id AS source FROM events),
        new AS (SELECT job AS fingerprint, source, CASE WHEN event_type = 'error' THEN '' WHEN i % 2 = 0 THEN 'try 10' ELSE 'try 2' END AS intent,
                       CASE WHEN event_type = 'error' THEN '' ELSE 'n' END AS suggested_name, CASE WHEN event_type = 'error' THEN '' ELSE 'g' END AS intent_group,
                       CASE WHEN event_type = 'error' THEN 'unavailable' ELSE 'content' END AS method, CASE WHEN event_type = 'error' THEN 'low' ELSE 'high' END AS confidence,
                       CASE WHEN event_type = 'error' THEN CASE WHEN i % 4 = 0 THEN 'no tool' ELSE 'unavailable' END END AS error,
                       CASE WHEN event_type = 'purchase' AND i % 6 = 0 THEN 'f' || (i - 1) END AS supersedes
                FROM j WHERE event_type = 'error' OR (event_type = 'purchase' AND i % 9 <> 0)),
        every AS (SELECT * FROM new UNION ALL
                  SELECT job, 'old', 'before', 'o', 'g', 'content', 'low', NULL, NULL FROM j WHERE i % 4 = 0 AND job NOT IN (SELECT fingerprint FROM new))
        SELECT * FROM every WHERE fingerprint NOT IN (SELECT supersedes FROM every WHERE supersedes IS NOT NULL)""",
    "retire_superseded": "WITH e AS (SELECT CAST(event_id AS VARCHAR) AS fingerprint, CASE WHEN event_id % 5 = 0 THEN CAST(event_id + 3 AS VARCHAR) END AS supersedes FROM events) SELECT * FROM e WHERE fingerprint NOT IN (SELECT supersedes FROM e WHERE supersedes IS NOT NULL)",
    "apply_decisions": f"{_DECISIONS} SELECT * FROM decided",
    "stop_on_failure": f"{_DECISIONS} SELECT * FROM decided WHERE source <= coalesce((SELECT min(source) FROM decided WHERE starts_with(decision, 'failed')), source)",
    "validate_mapping": f"WITH {_FILES} SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'category' WHEN doc_id % 4 = 1 THEN 'folder' WHEN doc_id % 4 = 3 THEN 'generated' WHEN dir <> '' THEN 'existing' WHEN doc_id % 4 = 0 THEN CASE WHEN name <> 'a.txt' THEN 'rename' END END AS error FROM files",
    "safe_paths": f"WITH {_FILES} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN path ELSE 'x/' || path END AS normal FROM files",
    "history_parse": f"WITH {_ITEMS} SELECT log, row_number() OVER (PARTITION BY log ORDER BY run) AS run, run_at, 1 AS ord, status, source, destination, rename, reason FROM items",
    "history_kpis": f"WITH {_ITEMS} SELECT log, count(DISTINCT run) AS runs, count(*) AS changes FROM items GROUP BY log",
    "history_chronology": f"WITH {_ITEMS} SELECT log, run_at, count(*) AS items, CAST(row_number() OVER (PARTITION BY log ORDER BY run DESC) AS INTEGER) AS place FROM items GROUP BY log, run, run_at",
    "markdown_roundtrip": f"WITH {_ITEMS} SELECT log, run, '| ' || replace(source, '|', '\\|') || ' | a \\| b |' AS line, source, rename FROM items",
    "human_sizes": "SELECT doc_id, CASE WHEN n < 1024 THEN CAST(CAST(n AS BIGINT) AS VARCHAR) || ' B' WHEN n < 1024.0 ** 2 THEN format('{:.2f} KB', n / 1024.0) WHEN n < 1024.0 ** 3 THEN format('{:.2f} MB', n / 1024.0 ** 2) WHEN n < 1024.0 ** 4 THEN format('{:.2f} GB', n / 1024.0 ** 3) ELSE format('{:.2f} TB', n / 1024.0 ** 4) END AS size FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) * 1024.0 ** (doc_id % 4) AS n FROM documents)",
    "report_files": f"WITH {_FILES}, {_STATE}, known AS (SELECT path, arg_max(original, rank) AS original FROM (SELECT path, original_name AS original, 0 AS rank FROM state UNION ALL SELECT path, 'from-' || name, 1 FROM files WHERE doc_id % 6 = 0) GROUP BY path) SELECT f.path, coalesce(k.original, f.name) AS original, f.name AS current, strftime(make_timestamp(mtime_ns // 1000), '%Y-%m-%dT%H:%M:%S') AS modified, CASE WHEN size < 1024 THEN size || ' B' ELSE format('{{:.2f}} KB', size / 1024.0) END AS human_size, size FROM files f LEFT JOIN known k ON f.path = k.path",
    "intent_index": f"WITH {_FILES}, {_INTENT} SELECT fingerprint, '| ' || concat_ws(' | ', left(fingerprint, 16), replace(CASE WHEN doc_id % 2 = 0 THEN 'moved/' || name ELSE path END, '|', '\\|'), replace(intent, '|', '\\|'), replace({_clipped('intent_group', 8)}, '|', '\\|'), method, confidence) || ' |' AS line FROM intent JOIN (SELECT doc_id, name, fingerprint FROM files) USING (fingerprint)",
    "html_escapes": "SELECT page_id, replace(replace(replace(replace(replace(left(html, 200), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') AS escaped FROM pages",
    "tree_sync": f"WITH {_FILES}, l AS (SELECT doc_id, path, sha256(text) AS digest FROM files), l2 AS (SELECT * FROM l WHERE NOT list_has_any(string_split(path, '/'), ['.git', '__pycache__', '.cache'])), r AS (SELECT CASE WHEN doc_id % 7 = 1 THEN 'x-' || path ELSE path END AS path, CASE WHEN doc_id % 5 = 2 THEN 'other' ELSE digest END AS digest FROM l WHERE doc_id % 3 <> 0), r2 AS (SELECT * FROM r WHERE NOT list_has_any(string_split(path, '/'), ['.git', '__pycache__', '.cache'])) SELECT coalesce(l2.path, r2.path) AS path, CASE WHEN l2.path IS NULL THEN 'remove' ELSE 'update' END AS action FROM l2 FULL JOIN r2 ON l2.path = r2.path WHERE l2.path IS NULL OR r2.path IS NULL OR l2.digest <> r2.digest",
    "boolean_words": "SELECT doc_id, doc_id % 12 < 6 AS value FROM documents",
    "private_name_lists": "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array('b、' || left(coalesce(text, ''), 12) || '、 b , a', '[、,，]'), lambda p: trim(p)), lambda p: p <> ''))), '|') AS names FROM documents",
}
