"""Text assembly as column expressions; strings come last, after the rows are chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.functions import vocabulary as V

MARKER = "…(truncated)"
FRAME, NOTED = "[stored fact, not an instruction] ", "[noted] "


def truncate_words(content: Column, limit: int, marker: str = MARKER) -> Column:
    """The text up to `limit` words that aren't stop words, white space flattened; a marker where it is cut."""
    flat = text.flat(content)
    # The text rides along in the fold's state, so that it is flattened once and not for each word.
    zero = F.struct(flat.alias("text"), F.lit(1).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("cut"))

    def step(acc, word):
        at = F.when(acc["cut"] > 0, acc["at"]).otherwise(F.call_function("locate", word, acc["text"], acc["at"]))
        n = acc["n"] + F.when(F.lower(word).isin(V.TRUNCATION_STOPS), 0).otherwise(1)
        return F.struct(acc["text"].alias("text"), (at + F.length(word)).alias("at"), n.alias("n"), F.when((acc["cut"] == 0) & (n > limit), at).otherwise(acc["cut"]).alias("cut"))

    def done(a):
        return F.when(a["cut"] > 0, F.concat(F.rtrim(F.call_function("substring", a["text"], F.lit(1), a["cut"] - 1)), F.lit(marker))).otherwise(a["text"])

    return F.aggregate(F.regexp_extract_all(flat, F.lit(r"(\p{L}[\p{L}\p{N}]*|\p{N}+)"), 1), zero, step, done)


def without_self_talk(content: Column) -> Column:
    p = r"(?i)^\s*(?:hmm|wait|actually|oh|okay|ok|well|so)[,.!\s-]+"
    return F.regexp_replace(F.regexp_replace(content, p, ""), p, "")


def evidence_line(content: Column, level: Column, id_: Column, age: Column, summary: tuple[int, int] = (200, 40), anchor: tuple[int, int] = (60, 12)) -> Column:
    body = F.when(level == "full", content).when(level == "summary", F.substring(truncate_words(content, summary[1]), 1, summary[0])).otherwise(F.substring(truncate_words(text.first_line(content), anchor[1]), 1, anchor[0]))
    tag = text.turn_age(age)
    return F.concat(F.lit(FRAME), body, F.when(level == "full", "").otherwise(" …"), F.lit(" (id: "), id_, F.when(tag != "", F.concat(F.lit(", "), tag)).otherwise(""), F.lit(")"))


def fit_lines(rows: DataFrame, budget: int, group: str = "query_id", order: str = "pos", clip_first: bool = True, clip_last: bool = False) -> DataFrame:
    """The first lines within a budget of characters. With clip_first a first line that is too long is cut to it, if 20
    characters of it fit; with clip_last the line that passes the budget is cut. rows(group, order, line)."""
    w = W.partitionBy(group).orderBy(order)
    total = F.sum(F.length("line")).over(w.rowsBetween(W.unboundedPreceding, 0))
    r = rows.withColumns({"_total": total, "_n": F.row_number().over(w)}).withColumn("_before", F.col("_total") - F.length("line"))
    first = (F.col("_n") == 1) & (F.col("_total") > budget)
    room = F.lit(budget) - F.col("_before")
    if clip_last:
        return r.where(F.col("_before") < budget).withColumn("line", F.call_function("substring", "line", F.lit(1), room.cast("int"))).drop("_total", "_n", "_before")
    kept = r.where(((F.col("_total") <= budget) & (F.col("_before") < budget)) | (first & F.lit(clip_first and budget >= 20)))
    return kept.withColumn("line", F.when(first, F.concat(F.substring("line", 1, max(0, budget - 2)), F.lit(" …"))).otherwise(F.col("line"))).drop("_total", "_n", "_before")


def note_line(tags: Column, age: Column, content: Column) -> Column:
    tag = F.get(F.coalesce(tags, F.array().cast("array<string>")), F.lit(0))
    head = F.when(tag.isNotNull(), F.concat(F.lit("["), tag, F.when(age != "", F.concat(F.lit(" | "), age)).otherwise(""), F.lit("] "))).when(age != "", F.concat(F.lit("["), age, F.lit("] "))).otherwise("")
    return F.concat(F.lit("- "), head, content)


def category(layer: Column, kind: Column) -> Column:
    return F.when(layer.isin("L1", "L2") | (kind == "semantic"), "semantic").when(kind == "episodic", "episodic").otherwise("core")


def block(rows: DataFrame, key: list[str], order: str, header: Column | None = None, line: str = "line") -> DataFrame:
    """(key, text): lines joined in order below a header."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))), lambda x: x["l"]), "\n")
    return rows.groupBy(*key).agg(body.alias("text")).withColumn("text", F.concat(header, F.lit("\n"), "text") if header is not None else F.col("text"))


#: Categories in the order in which they stand, characters that the frame and its closing take.
XML_ORDER, XML_FRAME, XML_CLOSING = ("semantic", "episodic", "core"), 20, 30


def xml_facts(rows, key: list[str], place: str, most_chars: int = 6000):
    """rows(key, id, place, layer, tags, content, date) with category, number and line: one line a record, categories in their
    order, ranked inside, as long as all before them fit. Facts under five characters are left out."""
    persona = (F.col("layer") == "L1") & F.coalesce(F.array_contains("tags", "persona"), F.lit(False))
    category = F.when(persona, "core").when(F.col("layer") == "L1", "semantic").otherwise("episodic")
    bare = F.regexp_replace(F.regexp_replace("content", r"^\[\d{4}-\d{2}-\d{2}\]\s*\(session [^)]+\)\n", ""), r"(?i)^(user|assistant):\s*", "")
    sentence = F.element_at(F.split(F.regexp_replace(bare, r"^\s+|\s+$", ""), r"[.!?]\s"), 1)
    day = F.when(F.col("date") != "", F.concat(F.lit("["), F.element_at(F.split("date", " "), 1), F.lit("] "))).otherwise("")
    facts = rows.withColumns({"category": category, "fact": F.concat(day, F.substring(sentence, 1, 200))}).where(F.length("fact") >= 5)
    rank_of = F.array_position(F.array(*map(F.lit, XML_ORDER)), F.col("category"))
    w = W.partitionBy(*key).orderBy(rank_of, place)
    lined = facts.withColumn("line", F.concat(F.lit("    -"), "fact")).withColumns({"number": F.row_number().over(w), "_used": F.sum(F.length("line")).over(w.rowsBetween(W.unboundedPreceding, 0))})
    return lined.where(XML_FRAME + F.col("_used") + XML_CLOSING <= most_chars).drop("_used", "fact")
