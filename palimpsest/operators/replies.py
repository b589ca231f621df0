"""Tolerant readers of model replies, and the prompts they answer. A model is a callable the caller passes in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories a fact may have; other ones count as the first.
CATEGORIES = ["fact", "preference", "lesson", "error", "state", "decision"]
FACT_CHARS, KEY_CHARS = 500, 64


def json_part(reply: Column) -> Column:
    """The outermost object of a reply, of its first fenced block if it has one; null if there is none."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.nullif(F.regexp_extract(F.when(fenced != "", fenced).otherwise(reply), r"(?s)(\{.*\})", 1), F.lit(""))


def response_text(response: Column) -> Column:
    """Text of a completion, given as JSON: its content if that is a string, else its text blocks, one below another; without
    either an empty text. A completion that stopped for an error raises."""
    r = F.from_json(response, "stopReason string, errorMessage string, content string")
    blocks = F.from_json(response, "content array<struct<type:string,text:string>>")["content"]
    texts = F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), lambda t: t.isNotNull())
    text = F.when(F.size(blocks) >= 0, F.array_join(texts, "\n")).otherwise(F.coalesce(r["content"], F.lit("")))
    return F.when(r["stopReason"] == "error", F.raise_error(F.concat(F.lit("completion failed: "), F.coalesce(r["errorMessage"], F.lit("unknown error")))).cast("string")).otherwise(text)


def _items(replies: DataFrame, name: str, fields: str) -> DataFrame:
    """Each object of the list `name`, read field by field, so that one malformed entry spoils no other."""
    part = F.from_json(json_part(F.col("reply")), f"{name} array<string>")[name]
    return replies.select("reply_id", F.posexplode(part).alias("i", "raw")).select("reply_id", "i", F.from_json("raw", fields).alias("x")).select("reply_id", "i", "x.*")


def _key(c: Column, default: str) -> Column:
    k = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9_-]+", "-"), "^-+|-+$", ""), 1, KEY_CHARS)
    return F.when(k != "", k).otherwise(default)


def _known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose references are all known; without any they are refused."""
    refs = rows.select("reply_id", "kind", "i", F.explode("sourceIds").alias("id")).join(known.select("id").distinct().withColumn("_ok", F.lit(1)), "id", "left")
    good = refs.groupBy("reply_id", "kind", "i").agg(F.count(F.lit(1)).alias("n"), F.count("_ok").alias("k")).where(F.col("n") == F.col("k"))
    return rows.join(good.drop("n", "k"), ["reply_id", "kind", "i"], "left_semi")


def fact_cards(replies: DataFrame, known: DataFrame) -> DataFrame:
    """(reply_id, kind, i, fact, topic, category, sourceIds) of replies(reply_id, reply); known(id) are the evidence ids.
    Ledger entries count only in replies that have a list of facts."""
    f = _items(replies, "facts", "fact string, topicKey string, category string, sourceIds array<string>").where(F.trim("fact") != "")
    cat = F.lower(F.coalesce("category", F.lit("fact")))
    facts = f.select("reply_id", F.lit("fact").alias("kind"), "i", F.substring(F.trim("fact"), 1, FACT_CHARS).alias("fact"), _key(F.coalesce("topicKey", F.lit("")), "fact").alias("topic"), F.when(cat.isin(CATEGORIES), cat).otherwise("fact").alias("category"), "sourceIds")
    whole = replies.where(F.from_json(json_part(F.col("reply")), "facts array<string>")["facts"].isNotNull())
    e = _items(whole, "ledger", "entity string, state string, date string, sourceIds array<string>").where((F.trim("entity") != "") & (F.trim("state") != ""))
    line = F.concat(F.lit("[ledger] "), F.trim("entity"), F.lit(" | "), F.trim("state"), F.when(F.trim(F.coalesce("date", F.lit(""))) != "", F.concat(F.lit(" | "), F.trim("date"))).otherwise(""))
    ledger = e.select("reply_id", F.lit("ledger").alias("kind"), "i", F.substring(line, 1, FACT_CHARS).alias("fact"), F.concat(F.lit("ledger-"), _key(F.col("entity"), "entity")).alias("topic"), F.lit("fact").alias("category"), "sourceIds")
    return _known(facts.unionByName(ledger), known)


def verdicts(replies: DataFrame) -> DataFrame:
    v = _items(replies, "verdicts", "id string, verdict string").withColumn("verdict", F.lower("verdict"))
    return v.where(F.col("id").isNotNull() & F.col("verdict").isin("supported", "unsupported")).groupBy("reply_id", "id").agg(F.max_by("verdict", "i").alias("verdict"))


def steps(replies: DataFrame) -> DataFrame:
    s = _items(replies, "steps", "id string, steps array<string>").withColumn("steps", F.filter(F.transform("steps", lambda s: F.trim(s)), lambda x: x != ""))
    return s.where(F.col("id").isNotNull() & (F.size("steps") > 0)).groupBy("reply_id", "id").agg(F.max_by("steps", "i").alias("steps"))


def reactivations(replies: DataFrame) -> DataFrame:
    part = F.from_json(json_part(F.col("reply")), "reactivate array<string>")["reactivate"]
    return replies.select("reply_id", F.explode(F.array_distinct(part)).alias("id")).where(F.col("id").isNotNull())


def prompts(rows: DataFrame, task: str, part: str = "scope", most_chars: int = 400) -> DataFrame:
    """(reply_id, prompt): one prompt for each part's selected rows(part, id, content, place)."""
    line = F.concat(F.lit("- ("), "id", F.lit(") "), F.substring(F.regexp_replace("content", r"\s+", " "), 1, most_chars))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"])
    return rows.groupBy(F.col(part).alias("reply_id")).agg(F.concat(F.lit(task + "\n"), F.array_join(lines, "\n")).alias("prompt"))


def complete(asked: DataFrame, model: Callable[[str], str], calls: int = 6) -> DataFrame:
    """replies(reply_id, reply) of at most `calls` prompts, by a callable that runs on the executors; what it can't answer is ''."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf["prompt"]:
                try:
                    out.append(model(p))
                except Exception:  # an unanswered prompt changes nothing
                    out.append("")
            yield pd.DataFrame({"reply_id": pdf["reply_id"], "reply": out})

    return asked.orderBy("reply_id").limit(calls).mapInPandas(run, "reply_id string, reply string")


def apply_verdicts(derived: DataFrame, judged: DataFrame) -> DataFrame:
    """derived with verified and storageStrength after verdicts(id, verdict): supported .8, unsupported .35."""
    j = derived.join(judged.select("id", "verdict"), "id", "left")
    return j.withColumns({"verified": F.when(F.col("verdict") == "supported", True).otherwise(F.col("verified")), "storageStrength": F.when(F.col("verdict") == "supported", 0.8).when(F.col("verdict") == "unsupported", 0.35).otherwise(F.col("storageStrength"))}).drop("verdict")
