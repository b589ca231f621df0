"""Maintenance of the store: duplicates, archiving, supersession, patterns, personas, selections for offline passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import score, text
from palimpsest.functions import vocabulary as V


def duplicate_marks(records: DataFrame, group: list[str] = ["scope"]) -> DataFrame:  # noqa: B006
    """(id, keeper): active records that say the same as another of their scope, and the one that stays: the latest by turn,
    then the strongest, then the smallest id. Keepers are found by a partial aggregate; a meaning that a third of all rows
    share is one row of the join's other side."""
    keyed = records.where(F.col("supersededBy").isNull() & ~F.coalesce("archived", F.lit(False))).withColumn("meaning", text.meaning_key(F.col("content"))).where(F.col("meaning") != "")
    keyed = keyed.withColumn("_h", F.xxhash64("meaning"))
    best = keyed.groupBy(*group, "_h", "meaning").agg(F.min_by("id", F.struct(-F.col("turn"), -F.col("storageStrength"), "id")).alias("keeper"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    return keyed.join(best, [*group, "_h", "meaning"]).where(F.col("id") != F.col("keeper")).select("id", "keeper")


def dream(records: DataFrame, folded: DataFrame, now: DataFrame, group: str = "scope") -> DataFrame:
    """records with keeper, archived and promotion as one maintenance pass leaves them.

    folded(id, extra) is the access log, now(scope, now) each scope's turn. Pinned records are never archived; the others
    are when their strength has decayed and enough turns have passed.
    """
    r = records.join(duplicate_marks(records, [group]), "id", "left").join(folded, "id", "left").join(now, group)
    sup = F.coalesce("supersededBy", "keeper")
    active = sup.isNull() & ~F.coalesce("archived", F.lit(False))
    weak = (score.retrieval_strength(F.col("retrievalStrength"), F.col("turn"), F.col("now")) < V.ARCHIVE_RS) & (F.col("now") - F.col("turn") > V.STALE_TURNS)
    r = r.withColumns({"superseded_by": sup, "newly_archived": active & (F.coalesce("storageStrength", F.lit(0.0)) < V.PINNED) & F.coalesce(weak, F.lit(False))})
    still = active & ~F.col("newly_archived")
    return r.withColumns({"active": still, "promoted": still & (F.coalesce(F.size("extra"), F.lit(0)) >= V.PROMOTE_AT) & ~F.coalesce("candidate", F.lit(False))})


def dream_report(dreamt: DataFrame, group: str = "scope") -> DataFrame:
    n = lambda c: F.count_if(c)
    return dreamt.groupBy(group).agg(F.count(F.lit(1)).alias("scanned"), F.count("keeper").alias("deduped"), n(F.col("newly_archived")).alias("archived"), n(F.col("promoted")).alias("promotion_candidates"), n(F.col("active")).alias("active"))


def supersession(derived: DataFrame, topic: list[str], order: list[str]) -> DataFrame:
    """derived with successor: the next row of its topic, which supersedes it; the last of a topic has none."""
    return derived.withColumn("successor", F.lead("id").over(W.partitionBy(*topic).orderBy(*order)))


def task_patterns(records: DataFrame, success: int = 3, failure: int = 2) -> DataFrame:
    """(subject, success, failure, status, first_id, n_scopes): tasks by normalised subject with enough outcomes."""
    facts = records.select("id", "scope", F.regexp_extract("content", V.TODO_FACT, 1).alias("kind"), text.task_subject(F.regexp_extract("content", V.TODO_FACT, 2)).alias("subject")).where((F.col("kind") != "") & (F.col("subject") != ""))
    g = facts.groupBy("subject").agg(F.count_if(F.col("kind") == "completed").alias("success"), F.count_if(F.col("kind") == "blocked").alias("failure"), F.min("id").alias("first_id"), F.countDistinct("scope").alias("n_scopes"))
    g = g.where((F.col("success") >= success) | (F.col("failure") >= failure))
    status = F.when((F.col("failure") >= failure) & (F.col("success") < success), "failing").when((F.col("success") >= success) & (F.col("failure") < failure), "reliable").otherwise("mixed")
    return g.withColumn("status", status)


def recall_by_task(records: DataFrame, ref: str) -> DataFrame:
    """Records of a task: procedures first, then evidence; by normalised reference."""
    key = text.task_subject(F.lit(ref))
    hit = records.where((text.task_subject(F.coalesce("taskref", F.regexp_extract("content", V.TODO_FACT, 2))) == key) & F.col("supersededBy").isNull())
    return hit.withColumn("section", F.when(F.col("layer") == "L2", 0).otherwise(1))


def persona(records: DataFrame, now: DataFrame, group: str = "scope", most: int = 6) -> DataFrame:
    """(scope, domain, n, last_turn, confidence, place): a scope's interests by words of its active records."""
    names = F.filter(F.array(*[F.when(F.lower("content").rlike(p), d) for d, p in V.DOMAINS.items()]), lambda x: x.isNotNull())
    hit = records.where(F.col("supersededBy").isNull() & (F.trim("content") != "")).select(group, "turn", F.explode(names).alias("domain"))
    g = hit.groupBy(group, "domain").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last_turn")).join(now, group)
    g = g.withColumn("confidence", score.persona_confidence(F.col("n"), F.col("last_turn"), F.col("now")))
    return g.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.round("confidence", 9).desc(), "domain"))).where(F.col("place") <= most).drop("now")


def consolidation_candidates(records: DataFrame, consumed: DataFrame, folded: DataFrame, group: str = "scope", most: int = 40) -> DataFrame:
    """The records a consolidation would read: active, not derived, not yet consumed; rehearsed ones first, then lessons and errors."""
    r = records.where(F.col("supersededBy").isNull() & ~F.coalesce("archived", F.lit(False)) & (F.coalesce("origin", F.lit("")) != "consolidation")).join(consumed.select("id"), "id", "left_anti").join(folded, "id", "left")
    priority = F.when(F.size(F.coalesce("accessLog", F.array().cast("array<bigint>"))) + F.coalesce(F.size("extra"), F.lit(0)) > 0, 0).when(F.col("category").isin("lesson", "error"), 1).otherwise(2)
    r = r.withColumn("priority", priority)
    return r.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy("priority", F.col("turn").desc(), "id"))).where(F.col("place") <= most)


def with_sources(derived: DataFrame, evidence: DataFrame, chars: int = 2000) -> DataFrame:
    """(id, n_refs, n_found, source_text): the evidence a derived record refers to, in the order of its references.

    derived(id, refs) with normalised references, evidence(ref, content).
    """
    each = derived.select("id", F.posexplode("refs").alias("i", "ref"))
    met = each.join(evidence, "ref", "left")
    g = met.groupBy("id").agg(F.count(F.lit(1)).alias("n_refs"), F.count("content").alias("n_found"), F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("i", "content")))).alias("c"))
    return g.select("id", "n_refs", "n_found", F.substring(F.array_join(F.transform("c", lambda x: x["content"]), " | "), 1, chars).alias("source_text"))


def goal_chain(goals: DataFrame, group: str = "scope") -> DataFrame:
    """(scope, id, focus, supersedes, active): a scope's goals, each once until the focus changes; the last is active.

    goals(scope, id, focus, turn).
    """
    w = W.partitionBy(group).orderBy("turn", "id")
    kept = goals.withColumn("_before", F.lag("focus").over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col("focus")))
    return kept.withColumns({"supersedes": F.lag("id").over(w), "active": F.lead("id").over(w).isNull()}).select(group, "id", "focus", "supersedes", "active")


def working_state(records: DataFrame, group: str = "scope", cap: int = 64) -> DataFrame:
    """(scope, list, items): distinct headlines by what they are about, the latest `cap`, in order of their text."""
    kind = F.when(F.array_contains("tags", "todo:blocked"), "blocked").when(F.array_contains("tags", "todo:completed"), "done").when(F.array_contains("tags", "file-op"), "files").when(F.col("category").isin("lesson", "error"), "lessons").when(F.col("category") == "preference", "preferences")
    item = F.when(kind == "files", text.content_path(F.col("content"))).otherwise(text.headline(text.first_line(F.col("content")), 120))
    rows = records.where(F.col("supersededBy").isNull()).select(group, kind.alias("list"), item.alias("item"), "turn").where(F.col("list").isNotNull() & F.col("item").isNotNull())
    once = rows.groupBy(group, "list", "item").agg(F.max("turn").alias("turn"))
    top = once.withColumn("i", F.row_number().over(W.partitionBy(group, "list").orderBy(F.col("turn").desc(), "item"))).where(F.col("i") <= cap)
    return top.groupBy(group, "list").agg(F.array_join(F.array_sort(F.collect_list("item")), "; ").alias("items"), F.count(F.lit(1)).alias("n"))
