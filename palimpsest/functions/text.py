"""Text functions as column expressions. Each has a twin in SQL, used to check it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import vocabulary as V

CJK = r"[\x{4e00}-\x{9fff}]"


def stem(w: Column) -> Column:
    """Words of five letters and more without ings, ing, ed, es or s; ies and ied become y. The longest ending that leaves three letters goes."""
    cut = F.regexp_replace(w, r"^(.{3,}?)(?:ings|ing|ed|es|s)$", "$1")
    y = F.when((F.length(w) >= 6) & w.rlike("ie[sd]$"), F.regexp_replace(w, "ie[sd]$", "y"))
    return F.when(w.rlike("^[a-z].{4}"), F.coalesce(y, cut)).otherwise(w)


def tokens(text: Column) -> Column:
    """The set of a text's stemmed lower-case words of three and more characters, and of its Han characters. Null: null."""
    words = F.transform(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_\-]{3,})"), 1)), stem)
    return F.array_distinct(F.concat(words, F.regexp_extract_all(text, F.lit(f"({CJK})"), 1)))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def overlap(a: Column, b: Column) -> Column:
    """Shared part of the smaller set; 0 if either is empty or null."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, shared(a, b) / least).otherwise(0.0)


def query_terms(query: Column) -> Column:
    """Distinct terms of a query, stop words dropped unless nothing else is left."""
    raw = F.filter(F.split(F.lower(query), r"[^a-z0-9_\-\x{4e00}-\x{9fff}]+"), lambda t: (F.length(t) >= 2) | t.rlike(CJK))
    good = F.filter(raw, lambda t: ~t.isin(V.QUERY_STOPS))
    return F.when(F.size(good) > 0, good).otherwise(raw)


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def meaning_key(text: Column) -> Column:
    """The form in which two records say the same."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), "[.。,，!！?？;；:：]+", ""))


def task_subject(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9\x{4e00}-\x{9fff}]+", " "))


def slug(text: Column, default: str = "fact", prefix: str = "") -> Column:
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "-"), "^-+|-+$", ""), 1, 64)
    return F.concat(F.lit(prefix), F.when(F.length(s) > 0, s).otherwise(F.lit(default)))


def record_id(*parts: Column) -> Column:
    return F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24))


def trace_id(session: Column, content: Column) -> Column:
    """The session a record belongs to: its own field, else the one named in the text's header, else null."""
    named = F.regexp_extract(content, V.SESSION_IN_HEADER, 1)
    return F.coalesce(F.when(F.trim(session) != "", F.trim(session)), F.when(named != "", named))


def headline(text: Column, n: int = 90) -> Column:
    return F.substring(flat(text), 1, n)


def first_line(text: Column) -> Column:
    return F.trim(F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0)))


def key_fact(text: Column, n: int = 120) -> Column:
    """First sentence of a record, without header and role."""
    body = F.regexp_replace(text, r"^\[\d{4}-\d{2}-\d{2}\]\s*\(session [^)]+\)\n", "")
    return F.substring(F.trim(F.regexp_replace(F.get(F.split(body, r"[.!?]\s"), F.lit(0)), r"(?i)^(user|assistant):\s*", "")), 1, n)


def counted_entity(question: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(question, r"(?i)how many\s+(?:\w+\s+)*?(\w[\w\s]*?)(?:\s+(?:do|did|have|has|are|were|was|is|have I|did I|am I))", 1)), F.lit(""))


def is_task(q: Column) -> Column:
    artifact = q.rlike(V.CODE_ARTIFACT) | q.rlike(V.CODE_TOKEN)
    asks, fails, thing = q.rlike(V.TASK_IMPERATIVE) | q.rlike(V.TASK_HOWTO), q.rlike(V.TASK_FAILURE), q.rlike(V.TASK_OBJECT)
    return artifact | (asks & (thing | fails)) | (fails & thing)


def question_class(q: Column) -> Column:
    return F.when(is_task(q), "task").when(q.rlike(V.ASSISTANT_CONTENT), "assistant-content").when(q.rlike(V.AGGREGATION), "aggregation").when(q.rlike(V.TEMPORAL), "temporal").when(q.rlike(V.PERSONAL_FACT), "personal-fact").otherwise("default")


def user_share(content: Column) -> Column:
    """Part of a record's characters that the user wrote; lines before any role count as the user's; 0.5 if there are none."""
    body = F.regexp_replace(content, V.HEADER, "")
    role = lambda l: F.lower(F.regexp_extract(l, r"(?i)^(user|assistant)\s*:\s?", 1))  # noqa: E731, E741
    rest = lambda l: F.length(F.regexp_replace(l, r"(?i)^(user|assistant)\s*:\s?", "")).cast("bigint")  # noqa: E731, E741

    def step(acc, line):
        now = F.when(role(line) != "", role(line)).otherwise(acc["who"])
        n = rest(line)
        return F.struct(now.alias("who"), (acc["user"] + F.when(now != "assistant", n).otherwise(F.lit(0))).alias("user"), (acc["total"] + n).alias("total"))

    zero = F.struct(F.lit("").alias("who"), F.lit(0).cast("bigint").alias("user"), F.lit(0).cast("bigint").alias("total"))
    return F.aggregate(F.split(body, "\n"), zero, step, lambda a: F.when(a["total"] > 0, a["user"] / a["total"]).otherwise(0.5))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.?!])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > 3)


def corrections(text: Column, most: int = 3) -> Column:
    """Sentences that correct or instruct, without bullets; of 8 to 300 characters; distinct, the first three."""
    parts = F.transform(F.split(text, r"[。！？!?\n；;]+|\.\s+"), lambda s: F.regexp_replace(F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")), r"^[-*>\s]+", ""))
    good = F.filter(parts, lambda s: F.length(s).between(8, 300) & (s.rlike(V.CORRECTION_ZH) | s.rlike(V.CORRECTION_EN)))
    return F.slice(F.array_distinct(good), 1, most)


def facts(text: Column) -> Column:
    """`key: value` of each rule that matches with a value of 3 to 199 characters."""
    found = []
    for key, pattern, groups in V.FACT_RULES:
        value = F.concat_ws(" ", *[F.trim(F.regexp_extract(text, pattern, g)) for g in range(1, groups + 1)])
        found.append(F.when(text.rlike(pattern) & F.length(value).between(3, 199), F.concat(F.lit(f"{key}: "), value)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def chunks(text: Column, size: int = 1200, most: int = 6) -> Column:
    """Windows of `size` characters, at most `most`; an empty text is one empty window."""
    n = F.least(F.greatest(F.ceil(F.length(text) / size), F.lit(1)), F.lit(most)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def note_age(mtime_ms: Column, now_ms: Column) -> Column:
    mins = F.floor(F.greatest(F.lit(0), now_ms - mtime_ms) / 60000 + 0.5)
    hours = F.floor(mins / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5).cast("int")
    return (
        F.when(mtime_ms.isNull() | (mtime_ms <= 0) | (mins < 15), "").when(mins < 60, "updated ~30m ago").when(hours < 4, "updated ~2h ago").when(hours < 12, "updated earlier today")
        .when(hours < 24, "updated today").when(hours < 48, "updated yesterday").when(days <= 7, F.concat(F.lit("updated ~"), days, F.lit("d ago"))).when(days <= 30, "updated ~weeks ago").otherwise("updated >1mo ago")
    )


def turn_age(age: Column) -> Column:
    return F.when(age < 3, "").when(age <= 5, "~3 turns ago").when(age <= 10, "~6 turns ago").when(age <= 20, "~10 turns ago").when(age <= 40, "~20 turns ago").otherwise(">40 turns ago")


def safe_name(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"[^a-zA-Z0-9._\-]+", "_"), 1, 120)


def content_path(text: Column) -> Column:
    """The first token that looks like a file's path."""
    return F.nullif(F.regexp_extract(text, r"([\w.\-]+(?:/[\w.\-]+)+\.\w+)", 1), F.lit(""))
