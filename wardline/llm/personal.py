"""Personal data: base patterns, and bootstrapped contextual extraction. DataFrame functions only.

Matches of the base patterns are seeds. The words around them are lexical patterns; a pattern is as good as
the share of its instances that are known, an instance as good as its patterns together. Round by round
good instances become known, raise their patterns and so lead to identifiers that no base pattern matches,
until a round finds nothing new.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.shared import Scratch

#: The base patterns, in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches without backtracking: repeats are possessive, and a match begins where a run of its
#: first characters does or where the match before ended. Very long runs then take linear time and no stack.
QUICK = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words with a digit or an at sign, with the groups of digits that follow: what a pattern may turn out to point at.
TOKEN = (
    r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
    r"(?:\x20[(+]?[0-9][0-9().,+/-]*+(?![^\x20\x09-\x0D]))*+"
)
#: A pattern counts from so many different known instances; an instance is accepted from this score.
LEAST_KNOWN, ACCEPTED = 3, 0.9
#: An accepted instance has so many digits, or an at sign.
LEAST_DIGITS = 5
#: Characters around a match in which its words are sought, and matches before it that may stand there.
_NEAR, _BACK = 64, 3


def _matches(kind: str, pattern: str, found: str, gaps: str) -> Column:
    """Matches in order, each with the length of the text since the one before and the words around.

    Gaps and matches in turn are the text, so what stands around a match is put together from those next to it.
    """
    before = [f"right({gaps}[i], {_NEAR})"]
    for n in range(1, _BACK + 1):
        before = [f"right(coalesce(get({gaps}, i - {n}), ''), {_NEAR})", f"right(coalesce(get({found}, i - {n}), ''), {_NEAR})", *before]
    after = f"left({gaps}[i + 1], {_NEAR}), left(coalesce(get({found}, i + 1), ''), {_NEAR}), left(coalesce(get({gaps}, i + 2), ''), {_NEAR})"
    return F.expr(
        f"""CASE WHEN size({found}) > 0 THEN transform(sequence(0, size({found}) - 1), i -> struct(
            '{kind}' AS kind, i AS i, length({gaps}[i]) AS gap, {found}[i] AS value,
            right(concat({", ".join(before)}), {_NEAR}) AS before, left(concat({after}), {_NEAR}) AS after)) END"""
    )


def marked(rows: DataFrame) -> DataFrame:
    """(row, key, marks): all matches of all patterns in the whole ``text`` of each row."""
    patterns = QUICK | {"token": TOKEN}
    found = rows.select(
        "row", "key", "text", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"found_{k}") for k, p in patterns.items())
    )
    split = found.select(
        "*", *(F.when(F.size(f"found_{k}") > 0, F.split("text", p, -1)).alias(f"gaps_{k}") for k, p in patterns.items())
    )
    marks = [_matches(k, p, f"found_{k}", f"gaps_{k}") for k, p in patterns.items()]
    return split.select("row", "key", F.filter(F.array(*marks), lambda m: m.isNotNull()).alias("marks")).select(
        "row", "key", F.flatten("marks").alias("marks")
    )


_DIGITS = "regexp_replace(value, '[^0-9]', '')"
#: Luhn's sum, from the last digit on: every second digit is doubled and its digits are added.
_LUHN = """aggregate(sequence(1, length(digits)), 0, (sum, i) -> sum +
    CASE WHEN i % 2 = 1 THEN int(substring(reverse(digits), i, 1))
         ELSE int(substring('0246813579', int(substring(reverse(digits), i, 1)) + 1, 1)) END) % 10 = 0"""
_IP = """forall(split(value, '[.]'), part -> length(ltrim('0', part)) <= 3
    AND coalesce(int(nullif(ltrim('0', part), '')), 0) <= 255)"""


def _valid() -> Column:
    return F.expr(
        f"""CASE kind WHEN 'ip' THEN {_IP}
            WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND {_LUHN}
            WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
            ELSE true END"""
    )


def _rank() -> Column:
    return F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(KINDS)) + " ELSE 9 END")


def occurrences(marks: DataFrame) -> DataFrame:
    """(row, kind, start, end, value, patterns): valid base spans, and words that overlap none of them.

    Offsets are code points, ends exclusive. A window holds the matches of one text.
    """
    rows = marks.select("row", F.explode("marks").alias("m")).select("row", "m.*")
    order = Window.partitionBy("row", "kind").orderBy("i")
    size = F.length("value").cast("long")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(order)).withColumn("start", F.col("end") - size)
    # A word is taken without the punctuation around it.
    head = F.length(F.regexp_extract("value", r"^[^\p{L}\p{N}@+]*+", 0))
    core = F.regexp_extract("value", r"^[^\p{L}\p{N}@+]*+(.*?)[^\p{L}\p{N}]*$", 1)
    token = F.col("kind") == "token"
    rows = rows.withColumn("core", F.when(token, core).otherwise(F.col("value")))
    rows = rows.withColumn("start", F.when(token, F.col("start") + head).otherwise(F.col("start")))
    rows = rows.withColumn("end", F.when(token, F.col("start") + F.length("core")).otherwise(F.col("end")))
    rows = rows.withColumn("digits", F.expr(_DIGITS)).where(_valid())
    base_end, base_start = F.when(~token, F.col("end")), F.when(~token, F.col("start"))
    past = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    coming = Window.partitionBy("row").orderBy("start").rangeBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("covered", F.max(base_end).over(past)).withColumn("coming", F.min(base_start).over(coming))
    free = (F.coalesce("covered", F.lit(0)) <= F.col("start")) & (F.coalesce("coming", F.col("end")) >= F.col("end"))
    fit = (F.length("digits") >= LEAST_DIGITS) | F.col("core").contains("@")

    def around_words(part: str) -> Column:
        """Words in lower case with every digit as #, so that numbers nearby don't make each context one of its own."""
        plain = F.regexp_replace(F.regexp_replace(F.lower(part), r"[\x20\x09-\x0D]+", " "), "[0-9]", "#")
        return F.split(F.trim(plain), " ")

    words, following = around_words("before"), around_words("after")
    rows = rows.where(~token | (free & fit)).withColumn("words", words).withColumn("next", F.element_at(following, 1))
    two = F.when(F.size("words") >= 2, F.concat(F.lit("two "), F.element_at("words", -2), F.lit(" "), F.element_at("words", -1)))
    around = F.when(
        (F.element_at("words", -1) != "") & (F.col("next") != ""),
        F.concat(F.lit("around "), F.element_at("words", -1), F.lit(" "), F.col("next")),
    )
    patterns = F.array_compact(F.array(two, around))
    return rows.select("row", "kind", "start", "end", F.col("core").alias("value"), patterns.alias("patterns"))


def bootstrapped(found: DataFrame, scratch: Scratch, rounds: int | None = None) -> DataFrame:
    """(value, kind): the seeds of ``occurrences`` and what patterns lead to from them.

    Rounds go on until one finds nothing new, or for ``rounds`` rounds; what is known only grows, so they end.

    Copies count once: a pattern is weighed by different instances. Counts are aggregated before they are
    joined, so a very common pattern or value is no burden on one task.
    """
    graph = scratch.keep(found.select("value", F.explode("patterns").alias("pattern")).distinct(), "graph")
    seeds = found.where("kind <> 'token'").groupBy("value").agg(F.min_by("kind", _rank()).alias("kind"))
    known = scratch.keep(seeds, "known")
    for _ in itertools.count() if rounds is None else range(rounds):
        edges = scratch.keep(graph.join(known, "value", "left"), "edges")
        sums = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
        share = [F.when(F.col(k) >= LEAST_KNOWN, F.col(k) / F.col("n")).otherwise(0.0).alias(k) for k in KINDS]
        weights = edges.groupBy("pattern").agg(F.count("*").alias("n"), *sums).select("pattern", *share)
        weights = scratch.keep(weights.where(" OR ".join(f"{k} > 0" for k in KINDS)), "weights")
        # A pattern that points at others too is never certain, so the logarithm is finite.
        missed = [F.exp(F.sum(F.log1p(-F.least(F.col(k), F.lit(1 - 1e-9))))).alias(k) for k in KINDS]
        scores = edges.where("kind IS NULL").join(weights, "pattern").groupBy("value").agg(*missed)
        best = F.array_max(F.array(*(F.struct((1 - F.col(k)).alias("score"), F.lit(-n).alias("rank")) for n, k in enumerate(KINDS))))
        new = scores.select("value", best.alias("best")).where(F.col("best.score") >= ACCEPTED)
        new = scratch.keep(new.select("value", F.element_at(F.array(*map(F.lit, KINDS)), 1 - F.col("best.rank")).alias("kind")), "new")
        scratch.drop(edges, weights)
        if new.isEmpty():
            break
        known, before = scratch.keep(known.unionByName(new), "known"), known
        scratch.drop(new, before)
    return known


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int | None = None) -> DataFrame:
    """(row, key, spans) for every row: all spans as struct(start, rank, end, kind, base), in order.

    ``base`` tells those of the base patterns from those that bootstrapping adds; an added span overlaps no
    base span. Null and empty texts have none, repeated rows each their own. ``row`` numbers the rows of
    this result. Other columns are left out.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    marks = scratch.keep(marked(rows), "marks")
    found = scratch.keep(occurrences(marks), "occurrences")
    known = bootstrapped(found, scratch, rounds).withColumnRenamed("kind", "led_to")
    added = found.where("kind = 'token'").drop("kind", "patterns").join(known, "value").select(
        "row", "start", "end", F.col("led_to").alias("kind"), F.lit(False).alias("base")
    )
    base = found.where("kind <> 'token'").select("row", "start", "end", "kind", F.lit(True).alias("base"))
    whole = F.struct("start", _rank().alias("rank"), "end", "kind", "base")
    lists = base.unionByName(added).groupBy("row").agg(F.sort_array(F.collect_list(whole)).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,base:boolean>>")
    return marks.select("row", "key").join(lists, "row", "left").select(
        "row", F.col("key").alias(key), F.coalesce("spans", empty).alias("spans")
    )


def listed(spans_: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def masked(text: Column, spans_: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans, the union.

    Spans are taken in order; what lies between them is copied.
    """
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))

    def step(done: Column, span: Column) -> Column:
        gap = F.greatest(span.start - done["at"], F.lit(0)).cast("int")
        kept = F.substring(text, (done["at"] + 1).cast("int"), gap)
        label = F.when(span.start >= done["at"], F.concat(F.lit("<"), span.kind, F.lit(">"))).otherwise("")
        return F.struct(F.concat(done["text"], kept, label).alias("text"), F.greatest(done["at"], span.end).alias("at"))

    return F.aggregate(
        spans_, start, step, lambda done: F.concat(done["text"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))
    )


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int | None = None) -> DataFrame:
    """``docs``, all columns, with each span of ``text`` replaced by its kind in angle brackets.

    Rows are written once with a number, by which spans meet their texts. Null texts stay null.
    """
    number = "row number of spans"
    scratch = Scratch(docs.sparkSession)
    numbered = scratch.numbered(docs, number)
    found = spans(numbered, number, text, rounds).where(F.size("spans") > 0).select(number, F.col("spans").alias("its spans"))
    joined = numbered.join(scratch.keep(found, "found"), number, "left")
    changed = F.when(F.col("its spans").isNull(), F.col(text)).otherwise(masked(F.col(text), F.col("its spans")))
    return joined.withColumn(text, changed).select(docs.columns)
