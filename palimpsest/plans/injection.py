"""The context put before a prompt, section by section, each with its share of the characters; and the facade of the store."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import render, score, temporal, text
from palimpsest.functions import vocabulary as V
from palimpsest.operators import graph, maintain, rank, recall
from palimpsest.plans import maintenance, search
from palimpsest.plans import recall as recall_plans
from palimpsest.plans import sqlparts as S
from palimpsest.runtime import cut, table
from palimpsest.sources.records import notes, records

BUDGET, SHARES = 4000, {"notes": 0.4, "emergent": 0.25, "gist": 0.2, "timeline": 0.2}


@dataclass(frozen=True)
class Config:
    """Settings of the extension; `pressure` is the part of the context window in use."""

    budget: int = BUDGET
    pressure: float = 0.0
    provider: str = "local"
    levels: tuple[float, float] = V.LEVELS
    extra: dict = field(default_factory=dict)

    @property
    def semantic_weight(self) -> float:
        return V.PROVIDER_WEIGHT.get(self.provider, V.PROVIDER_WEIGHT["local"])

    @property
    def settings(self) -> dict[str, float]:
        window = 128_000
        return score.compression(self.pressure, self.budget, int(self.pressure * window), window, *self.levels, V.ACTIVATION)

    @classmethod
    def read(cls, path: str, env: dict | None = None) -> Config:
        """From a JSON file, environment first; a missing or corrupt file means defaults."""
        try:
            with open(path) as f:
                stored = json.load(f)
        except (OSError, ValueError):
            stored = {}
        stored = stored if isinstance(stored, dict) else {}
        provider = (env if env is not None else os.environ).get("PALIMPSEST_PROVIDER") or stored.get("provider")
        return cls(provider=provider if provider in V.PROVIDER_WEIGHT else "local", budget=int(stored.get("budget", BUDGET)))

    def write(self, path: str) -> None:
        with open(f"{path}.tmp", "w") as f:
            json.dump({"provider": self.provider, "budget": self.budget}, f)
        os.replace(f"{path}.tmp", path)


def injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, section, pos, id, line): what is put before each question, in sections, each line with its record's id."""
    ranked = rank.fidelity(rank.placed(rank.scored(search.pool(spark, sf_dir).where(~F.col("archived")), V.WEIGHTS_CONTEXT)))
    asks_when = (F.col("pos") <= 30) & F.col("query").rlike(V.TEMPORAL_PROMPT)
    # Scored before it is written, and without what only the score needs.
    p = cut(ranked.select("query_id", "id", "pos", "score", "level", "content", "turn", "now", "date", "layer", "kind", "taskref", "path", "paths", "sourceRefs", "supersededBy", "storageStrength", asks_when.alias("asks_when")))
    gated = p.where((F.round("score", 9) >= V.ACTIVATION) | (F.col("storageStrength") >= V.PINNED))
    q = table(spark, sf_dir, "recall_query").select("query_id", "query")
    n = notes(spark, sf_dir, {"id": F.col("id"), "content": F.col("content"), "tags": F.col("tags"), "mtime": F.col("metadata.mtimeMs")}).where(F.trim("content") != "")
    office = F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, V.OFFICE_TAGS)))
    about = table(spark, sf_dir, "note_record").count()  # from the files' footers
    near = recall.lexical_top(q, n, 20, about).join(n, "id").withColumn("_o", (~office).cast("int") * 1000 + F.col("pos"))
    noted = render.fit_lines(near.select("query_id", F.col("_o").alias("pos"), "id", render.note_line(F.col("tags"), F.lit(""), F.col("content")).alias("line")), int(BUDGET * SHARES["notes"]), clip_last=True)
    pairs, hubs = map(cut, graph.edges(p, "query_id"))
    seeds = cut(gated.where(F.col("pos") <= V.SEEDS).select("query_id", "id", F.col("score").alias("energy")))
    emerged = graph.spread(pairs, hubs, seeds, "query_id").join(p.select("query_id", "id", "content"), ["query_id", "id"])
    body = F.substring(render.truncate_words(F.col("content"), 40), 1, 200)
    emergent = render.fit_lines(emerged.select("query_id", F.col("place").alias("pos"), "id", F.concat(F.lit("- " + render.FRAME), body, F.lit(" (id: "), "id", F.lit(")")).alias("line")), int(BUDGET * SHARES["emergent"]), clip_first=False)
    dated = gated.where("asks_when").withColumn("date_key", temporal.date_key(F.col("date")))
    line = recall.timeline(dated)
    line = line.withColumn("pos", F.row_number().over(search.rank.W.partitionBy("query_id").orderBy("axis", "at"))).select("query_id", "pos", F.lit(None).cast("string").alias("id"), F.concat(F.lit("- "), F.when(F.col("axis") == "turn", F.concat(F.lit("turn "), F.col("at").cast("bigint"))).otherwise(F.col("at")), F.lit(": "), "headline").alias("line"))
    times = render.fit_lines(line, int(BUDGET * SHARES["timeline"]), clip_first=False)
    parts = [noted.withColumn("section", F.lit(1)), emergent.withColumn("section", F.lit(3)), times.withColumn("section", F.lit(2))]
    aids = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("query_id", "section", F.col("pos").cast("int").alias("pos"), "id", "line")
    aids = cut(aids)
    spent = aids.groupBy("query_id").agg(F.sum(F.length("line") + 1).alias("spent"))
    w = search.rank.W.partitionBy("query_id").orderBy("pos").rowsBetween(search.rank.W.unboundedPreceding, 0)
    # Lines are made only where those before leave room: up to where even the least that all of them take passes the budget.
    least = F.when(F.col("level") == "full", F.length("content")).otherwise(0) + F.length("id") + len(render.FRAME)
    some = gated.withColumn("_least", F.sum(least).over(w)).where((F.col("_least") <= BUDGET) | (F.col("pos") == 1))
    lines = some.select("query_id", "pos", "id", render.evidence_line(F.col("content"), F.col("level"), F.col("id"), F.when((F.col("layer") == "L0") & (F.col("turn") > 0), F.col("now") - F.col("turn")).otherwise(F.lit(0))).alias("line"))
    fits = lines.join(spent, "query_id", "left").withColumn("_t", F.sum(F.length("line")).over(w)).where((F.col("_t") <= BUDGET - F.coalesce("spent", F.lit(0))) | (F.col("pos") == 1))
    evidence = fits.select("query_id", F.lit(4).alias("section"), F.col("pos").cast("int").alias("pos"), "id", "line")
    return aids.unionByName(evidence)


def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as summary and anchor lines show them."""
    r = records(spark, sf_dir, ["id", "content"]).where(F.trim("content") != "")
    c = render.without_self_talk(F.col("content"))
    return r.select("id", F.md5(render.truncate_words(c, 12)).alias("anchor"), F.length(render.truncate_words(c, 40)).alias("summary_chars"), render.category(F.lit("L0"), F.lit("episodic")).alias("category"))


def find_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purged id the first row of that id, evidence before derived records before notes."""
    asked = table(spark, sf_dir, "purged_id").select("id").distinct()
    r = maintenance.store(spark, sf_dir).select("id", "scope", F.when(F.col("layer") == "L0", 0).when(F.col("layer") == "L1", 1).otherwise(2).alias("section"))
    n = notes(spark, sf_dir, ["id", "scope"]).select("id", "scope", F.lit(3).alias("section"))
    return asked.join(r.unionByName(n), "id").groupBy("id").agg(F.min_by("scope", "section").alias("scope"), F.min("section").alias("section"))


class Memory:
    """The store's actions over a folder of tables: write, list, recall, get, task, correct, seed."""

    def __init__(self, spark: SparkSession, sf_dir: str, embed: Callable[[str], list[float]] | None = None):
        self.spark, self.sf_dir, self.embed = spark, sf_dir, embed

    def _active(self) -> DataFrame:
        return maintenance.store(self.spark, self.sf_dir).where(F.col("supersededBy").isNull() & (F.trim("content") != ""))

    def list(self, scope: str) -> DataFrame:
        return self._active().where(F.col("scope") == scope).select("id", "layer", "turn", text.headline(F.col("content")).alias("headline"))

    def get(self, id_: str) -> DataFrame:
        return maintenance.store(self.spark, self.sf_dir).where(F.col("id") == id_)

    def recall(self, query: str, scope: str | None = None) -> DataFrame:
        rows = self._active().where(F.col("scope") == scope) if scope else self._active()
        asked = rows.withColumns({"query_id": F.lit("q"), "query": F.lit(query)})
        return recall.bm25(asked).join(rows.select("id", "content"), "id").orderBy("place")

    def search(self, query: str, scope: str | None = None, top_k: int = 10, question_date: str | None = None, options: "search.Options" = search.Options()) -> DataFrame:
        """(id, pos, score, chars, content) of one question's records, as the search pipeline ranks them within its budget.
        Candidates are the scope's active records; with `embed`, the question's vector is held against the records'."""
        spark = self.spark
        asked = spark.createDataFrame([("q", query, None, question_date, top_k, None)], "query_id string, query string, options array<string>, question_date string, top_k int, semanticWeight double")
        found = self._active().where(F.col("scope") == scope) if scope else self._active()
        sig = found.select(F.lit("q").alias("query_id"), "id", F.lit(None).cast("double").alias("rerank"))
        if self.embed is None:
            sig = sig.withColumn("sem", F.lit(None).cast("double"))
        else:
            mine = F.array(*[F.lit(float(x)) for x in self.embed(query)])
            near = recall_plans.record_vectors(spark, self.sf_dir).where(F.size("vec") == F.size(mine)).select("id", score.cosine(F.col("vec"), mine).alias("sem"))
            sig = sig.join(near, "id", "left")
        rows = search.search(search.pool(spark, self.sf_dir, asked, sig), options).where(F.col("pos") <= top_k)
        return rows.join(found.select("id", "content"), "id").select("id", "pos", "score", "chars", "content").orderBy("pos")

    def task(self, ref: str) -> DataFrame:
        return maintain.recall_by_task(maintenance.store(self.spark, self.sf_dir), ref)

    def correct(self, message: str) -> DataFrame:
        """Sentences of a message to be kept as notes on behaviour."""
        return self.spark.range(1).select(F.explode(text.corrections(F.lit(message))).alias("line"))

    def seed(self, lines: str) -> DataFrame:
        from palimpsest.operators import ingest

        rows = self.spark.range(1).select(F.explode(F.split(F.lit(lines), "\n")).alias("line"))
        return ingest.seeds(rows).select(text.record_id(F.lit("persona"), F.col("facet"), F.col("seed")).alias("id"), "facet", "seed", F.lit("L1").alias("layer"), F.lit(0.9).alias("storageStrength"), F.lit(0.9).alias("retrievalStrength")).dropDuplicates(["id"])

    def write(self, scope: str, content: str, turn: int, path: str) -> int:
        """Evidence appended once to the table at `path`; how many rows were added."""
        from palimpsest.sources import sinks

        row = self.spark.range(1).select(F.lit(scope).alias("scope"), text.record_id(F.lit(scope), F.lit(content)).alias("id"), F.lit(content).alias("content"), F.lit(turn).cast("bigint").alias("turn"))
        return sinks.append_new(row, path, ["scope", "id"], ["turn"])


QUERIES = {"injection": injection, "truncated_lines": truncated, "find_by_id": find_by_id}
SQL = {"find_by_id": f"with u as (select id, scope, case layer when 'L0' then 0 when 'L1' then 1 else 2 end section from {S.REC} union all select id, scope, 3 from {S.NOTE}) select u.id, min_by(scope, section) as scope, min(section) section from u where id in (select id from purged_id) group by 1"}
