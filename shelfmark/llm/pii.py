"""Personal data: base patterns, and contextual extraction bootstrapped from them. DataFrame functions only.

Base spans seed a bipartite graph of lexical patterns (the word before or after an identifier) and
instances (the identifier itself). A pattern's confidence is the share of its occurrences in the corpus that stand at
identifiers believed in; occurrences at words that only look like identifiers count UNKNOWN times, all others once. An
unseen instance is believed in if its confident patterns together suggest it (noisy or). The scores are updated in
rounds until they stand still: what one pattern discovers can make another one confident. What is discovered is
reported wherever it stands, beside the base spans, as kind "context".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone", "context")
#: Distinct identifiers believed in that a pattern needs.
SUPPORT = 5
#: A pattern of this confidence discovers, and an instance of this belief is reported.
CONFIDENT = 0.8
#: What an occurrence at a word of unknown kind takes away, where one at a word that can't be an identifier takes 1.
UNKNOWN = 0.25
#: Characters before and after a span in which its neighbouring words are looked for.
NEAR = 48

# The base patterns, written so that no run of characters is scanned again from each of its characters: possessive
# repeats, and a start where a run starts or the last match ended.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # Identifier-shaped words: at least four digits, or an at sign within.
    "context": r"(?<![\p{L}\p{N}@._+/-])(?=(?:[A-Za-z@._+/-]*[0-9]){4}|[A-Za-z0-9._+/-]+@[A-Za-z0-9])[A-Za-z0-9](?:[A-Za-z0-9@._+/-]*[A-Za-z0-9])?+",
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits: from the right, every second digit counts double, less 9 if above 9."""
    r = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(r, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), lambda t, i: t + value(i)) % 10 == 0


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda m: F.when(F.length(_digits(m)).between(14, 19), luhn(_digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
    "context": lambda m: F.lit(True),
}
_MAY = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.contains(t, F.lit(".")),
    "card": lambda t: F.lit(True),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "context": lambda t: F.lit(True),
}


def with_spans(rows: DataFrame, text: str, patterns: dict[str, str], valid: dict) -> DataFrame:
    """Adds to rows one array for each pattern: structs of start, end (code points), hit, and the words left and right.

    The texts between the matches are what is left when a mark, which is taken out of the text first, replaces them;
    lengths of those and of the matches give the positions.
    """
    t, mark = F.col(text), "\u0001"
    rows = rows.withColumns({f"{k}_hits": F.when(_MAY.get(k, lambda x: F.lit(True))(t), F.regexp_extract_all(t, F.lit(p), F.lit(0))) for k, p in patterns.items()})
    rows = rows.withColumns({f"{k}_gaps": F.when(F.size(f"{k}_hits") > 0, F.split(F.regexp_replace(F.translate(t, mark, "\u0002"), F.lit(p), F.lit(mark)), mark, -1)) for k, p in patterns.items()})

    def spans(k: str) -> Column:
        hits, gaps = F.col(f"{k}_hits"), F.col(f"{k}_gaps")
        kind = "struct<pos:int,out:array<struct<start:int,end:int,hit:string,left:string,right:string>>>"

        def step(acc: Column, i: Column) -> Column:
            start = acc["pos"] + F.length(F.get(gaps, i))
            end = start + F.length(F.get(hits, i))
            left = F.regexp_extract(F.lower(F.substring(F.get(gaps, i), -NEAR, NEAR)), r"(\S+)\s*$", 1)
            right = F.regexp_extract(F.lower(F.substring(F.get(gaps, i + 1), 1, NEAR)), r"^\s*(\S+)", 1)
            one = F.struct(start.alias("start"), end.alias("end"), F.get(hits, i).alias("hit"), left.alias("left"), right.alias("right"))
            return F.struct(end.alias("pos"), F.when(valid[k](F.get(hits, i)), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out")).cast(kind)

        empty = F.struct(F.lit(0).alias("pos"), F.array().alias("out")).cast(kind)
        found = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), empty, step, lambda acc: acc["out"])
        return F.when(F.size(hits) > 0, found).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string,left:string,right:string>>"))

    return rows.withColumns({k: spans(k) for k in patterns}).drop(*(f"{k}_{x}" for k in patterns for x in ("hits", "gaps")))


def _listed(arrays: list[tuple[str, Column]]) -> Column:
    """kind:start:end of all spans, by start and then by kind as listed."""

    def keyed(kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"))

    order = [F.transform(a, keyed(k)) for k, a in arrays]
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.concat(*order)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _graph(found: DataFrame, base: tuple[str, ...], support: int) -> DataFrame:
    """(pattern, instance, seed, n): how often the pattern stands at the instance. Patterns of fewer than `support` instances can't count."""
    near = lambda s: F.array(F.concat(F.lit("L "), s["left"]), F.concat(F.lit("R "), s["right"]))
    seeds = F.transform(F.concat(*(F.col(k) for k in base)), lambda s: F.struct(s["hit"].alias("hit"), near(s).alias("near"), F.lit(True).alias("seed")))
    others = F.transform("context", lambda s: F.struct(s["hit"].alias("hit"), near(s).alias("near"), F.lit(False).alias("seed")))
    spans = found.select(F.explode(F.concat(seeds, others)).alias("x"))
    edges = spans.select(F.lower("x.hit").alias("instance"), F.col("x.seed").alias("seed"), F.explode("x.near").alias("pattern")).filter(F.length("pattern") > 2)
    edges = written(edges.groupBy("pattern", "instance").agg(F.bool_or("seed").alias("seed"), F.count("*").alias("n")), "pii-edges")
    enough = edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("beside")).filter(F.col("instances") >= support)
    return written(edges.join(enough.select("pattern", "beside"), "pattern"), "pii-graph")


def _scored(graph: DataFrame, totals: DataFrame, support: int, confident: float) -> DataFrame:
    """(instance) unseen ones that are believed in once patterns and instances, scored in turn, stand still.

    What is believed in stays so, and each round but the last adds to it.
    """
    graph = graph.join(totals, "pattern", "left").withColumn("total", F.greatest("beside", F.coalesce("total", F.lit(0))))
    graph = written(graph, "pii-weighted")
    believed, known = graph.withColumn("sure", F.col("seed")), -1
    while True:
        sure = F.sum(F.when(F.col("sure"), F.col("n")).otherwise(0))
        score = believed.groupBy("pattern").agg(sure.alias("sure"), F.max("beside").alias("beside"), F.max("total").alias("total"), F.count_if("sure").alias("instances"))
        confidence = F.col("sure") / (F.col("sure") + UNKNOWN * (F.col("beside") - F.col("sure")) + F.col("total") - F.col("beside"))
        score = score.filter(F.col("instances") >= support).select("pattern", confidence.alias("confidence")).filter(F.col("confidence") >= confident - 1e-9)
        near = graph.filter("not seed").join(score, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("belief"))
        found = written(near.filter(F.col("belief") >= confident - 1e-9).select("instance"), "pii-believed")
        now = found.count()
        if now == known or now == 0:
            return found
        known = now
        believed = graph.join(found.withColumn("found", F.lit(True)), "instance", "left").withColumn("sure", F.col("seed") | F.coalesce("found", F.lit(False)))


def find_personal_data(docs: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans.

    Spans are kind:start:end in code points, comma-joined by start and kind; base_sha256 is that of the four base kinds
    alone. Rows are independent but for the patterns learnt: repeated rows, ties and null identifiers keep rows of
    their own; a null or empty text has no spans; an empty table gives an empty result; other columns are not read.
    Work on one text grows with its length, and with the square of its matches (arrays are copied to grow). Words of
    more than NEAR characters make no pattern with a count of their own.
    """
    base = KINDS[:4]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = with_spans(rows, "text", PATTERNS, _VALID).drop("text")
    known = F.concat(*(F.col(k) for k in base))
    found = found.withColumn("known", F.transform(known, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    found = found.withColumn("context", F.filter("context", lambda c: ~F.exists("known", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))).drop("known")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "pii-found")

    graph = _graph(found, base, support)
    words = rows.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).groupBy("word").agg(F.count("*").alias("total"))
    patterns = graph.select("pattern").distinct().withColumn("word", F.substring("pattern", 3, 1 << 20))
    discovered = _scored(graph, patterns.join(words, "word").select("pattern", "total"), support, confident)
    unseen = found.filter(F.size("context") > 0).select("row", F.explode("context").alias("c")).select("row", "c.start", "c.end", F.lower("c.hit").alias("instance"))
    more = unseen.join(discovered, "instance").groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("more"))
    out = found.join(more, "row", "left").withColumn("more", F.coalesce("more", F.array().cast("array<struct<start:int,end:int>>")))
    arrays = [(k, F.col(k)) for k in base]
    return out.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.size("more").cast("long").alias("n_context"),
        F.sha2(_listed(arrays), 256).alias("base_sha256"),
        _listed([*arrays, ("context", F.col("more"))]).alias("spans"),
    )
