"""Queries of maintenance and of the association graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.functions import vocabulary as V
from palimpsest.operators import graph, maintain, rank
from palimpsest.plans import recall, search
from palimpsest.plans import sqlparts as S
from palimpsest.runtime import cut, table
from palimpsest.sources.records import records, ref_key


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("metadata")
    plain = ["id", "scope", "layer", "kind", "content", "turn", "accessLog", "tags", "sourceRefs", "supersededBy", "archived", "category", "ingested_at"]
    keep = {c: F.col(c) for c in plain} | {"storageStrength": F.coalesce("storageStrength", F.lit(0.0)), "retrievalStrength": F.coalesce("retrievalStrength", F.lit(0.0)), "taskref": m["taskRef"], "path": m["path"], "paths": m["paths"], "topic": m["topicKey"], "origin": m["origin"], "verified": m["verified"], "enriched": m["enriched"], "candidate": m["promotionCandidate"], "focus": m["focusKey"], "consolidated": m["consolidatedIds"], "ledger": m["ledger"], "aggregate": m["aggregate"]}
    return records(spark, sf_dir, keep)


def _now(r: DataFrame) -> DataFrame:
    return r.groupBy("scope").agg((F.max("turn") + 1).alias("now"))


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.fold_access(table(spark, sf_dir, "access_log"))


def duplicate_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.duplicate_marks(store(spark, sf_dir))


def _late(r: DataFrame, turns: int = 40) -> DataFrame:
    return _now(r).withColumn("now", F.col("now") + turns)


def _dreamt(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = store(spark, sf_dir)
    return maintain.dream(r, _folded(spark, sf_dir), _late(r))


def dream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.dream_report(_dreamt(spark, sf_dir))


def dream_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pass changes: records newly superseded, archived or promoted."""
    d = _dreamt(spark, sf_dir)
    return d.where(F.col("keeper").isNotNull() | F.col("newly_archived") | F.col("promoted")).select("id", "superseded_by", F.col("newly_archived").alias("archived"), F.col("promoted").alias("promotion"))


def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = store(spark, sf_dir).where(F.col("topic").isNotNull() & F.col("layer").isin("L1", "L2"))
    return maintain.supersession(d, ["topic"], ["ingested_at", "id"]).where(F.col("successor").isNotNull()).select("id", "topic", "successor")


def task_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.task_patterns(store(spark, sf_dir))


def task_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.recall_by_task(store(spark, sf_dir), "fix the alias table").select("section", "id", "turn")


def persona(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = store(spark, sf_dir)
    return maintain.persona(r, _now(r)).select("scope", "domain", "n", "last_turn", "place", F.round("confidence", 6).alias("confidence"))


def consolidation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = store(spark, sf_dir)
    used = r.select(F.explode(F.coalesce("consolidated", "sourceRefs")).alias("ref")).select(ref_key(F.col("ref")).alias("id")).where(F.col("id").isNotNull()).distinct()
    return maintain.consolidation_candidates(r, used, _folded(spark, sf_dir)).select("scope", "id", "priority", "place")


def deep_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records the offline pass would verify, enrich or bring back, for each scope."""
    from pyspark.sql import Window as W

    r = store(spark, sf_dir).where(F.col("supersededBy").isNull())
    n = lambda df, k: df.withColumn("place", F.row_number().over(W.partitionBy("scope").orderBy("id"))).where(F.col("place") <= k)
    verify = n(r.where((F.col("layer") == "L1") & ~F.coalesce("verified", F.lit(False))), 3).select(F.lit("verify").alias("action"), "scope", "id", "place")
    task = text.task_subject(F.coalesce("taskref", F.regexp_extract("content", V.TODO_FACT, 2)))
    enough = r.where(F.col("layer") == "L0").select(task.alias("task")).where(F.col("task") != "").groupBy("task").agg(F.count(F.lit(1)).alias("n_evidence")).where(F.col("n_evidence") >= 3)
    cards = r.where((F.col("layer") == "L2") & ~F.coalesce("enriched", F.lit(False))).withColumn("task", task)
    enrich = n(cards.join(enough, "task", "left_semi"), 2).select(F.lit("enrich").alias("action"), "scope", "id", "place")
    focus = text.tokens(F.lit("prompt cache and vector cache retries"))
    back = n(r.where(F.coalesce("archived", F.lit(False)) & (text.shared(focus, text.tokens(F.col("content"))) > 0)), 4).select(F.lit("reactivate").alias("action"), "scope", "id", "place")
    return verify.unionByName(enrich).unionByName(back)


def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = store(spark, sf_dir)
    refs = F.filter(F.transform(F.col("sourceRefs"), ref_key), lambda x: x.isNotNull())
    d = r.where(F.col("layer").isin("L1", "L2")).select("id", refs.alias("refs"))
    return maintain.with_sources(d, r.where(F.col("layer") == "L0").select(F.col("id").alias("ref"), "content")).select("id", "n_refs", "n_found", F.md5("source_text").alias("digest"))


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived records that a store would refuse: no references, or one to no known evidence."""
    r = store(spark, sf_dir)
    d = r.where(F.col("layer").isin("L1", "L2")).select("id", F.explode_outer("sourceRefs").alias("ref")).select("id", ref_key(F.col("ref")).alias("ref"))
    known = r.where(F.col("layer") == "L0").select(F.col("id").alias("ref"), F.lit(1).alias("ok"))
    return d.join(known, "ref", "left").groupBy("id").agg(F.count("ref").alias("n_refs"), F.count("ok").alias("n_known")).where((F.col("n_refs") == 0) | (F.col("n_known") < F.col("n_refs")))


def goal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.goal_chain(store(spark, sf_dir).where(F.trim("focus") != "").select("scope", "id", "focus", "turn"))


def working_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.working_state(store(spark, sf_dir))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = store(spark, sf_dir)
    accessed = table(spark, sf_dir, "access_log").where(F.col("id").isNotNull()).select("id").distinct().withColumn("_a", F.lit(1))
    return r.join(accessed, "id", "left").groupBy("scope").agg(F.count_if(F.col("layer") == "L0").alias("evidence"), F.count_if(F.coalesce("archived", F.lit(False))).alias("archived"), F.count_if(F.col("layer") == "L1").alias("facts"), F.count_if(F.col("layer") == "L2").alias("procedures"), F.count("_a").alias("accessed"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(store(spark, sf_dir), "scope", None)[0].select("scope", "src", "dst", "kind", "weight")


def _pool_graph(spark: SparkSession, sf_dir: str):
    p = cut(search.pool(spark, sf_dir))  # read by every kind of edge
    pairs, hubs = map(cut, graph.edges(p, "query_id"))
    ranked = rank.placed(rank.scored(p, V.WEIGHTS_CONTEXT))
    seeds = ranked.where((F.col("pos") <= V.SEEDS) & (F.round("score", 9) >= V.ACTIVATION)).select("query_id", "id", F.col("score").alias("energy"))
    return pairs, hubs, cut(seeds)


def spread_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.spread(*_pool_graph(spark, sf_dir), "query_id").select("query_id", "id", "place", F.round("energy", 6).alias("energy"))


def similar_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = search.pool(spark, sf_dir).select("query_id", "id").join(recall.record_vectors(spark, sf_dir), "id")
    return graph.similar(p, "query_id").select("query_id", "src", "dst", F.round("weight", 5).alias("weight"))


QUERIES = {f.__name__: f for f in (duplicate_marks, dream_report, dream_governance, supersession, task_patterns, task_recall, persona, consolidation_candidates, deep_selection, source_texts, provenance, goal_chain, working_state, status_counts, graph_edges, spread_activation, similar_edges)}

_R = f"r as (select *, coalesce(archived, false) arch, metadata.taskRef taskref, metadata.topicKey topic from {S.REC}), acc as {S.ACC}"
_MEAN = r"trim(regexp_replace(regexp_replace(lower(content), '\s+', ' ', 'g'), '[.。,，!！?？;；:：]+', '', 'g'))"
_DUP = f"act as (select *, {_MEAN} mk from r where supersededBy is null and not arch), dup as (select *, first_value(id) over (partition by scope, mk order by turn desc, coalesce(storageStrength, 0) desc, id) keeper from act where mk <> ''), mark as (select id, keeper from dup where id <> keeper)"
_DREAM = f"""with {_R}, {_DUP}, nw as (select scope, max(turn) + 41 as now from r group by 1),
d0 as (select r.*, keeper, coalesce(r.supersededBy, keeper) sup, len(coalesce(a.turns, [])) na, now from r left join mark using (id) left join acc a on a.id = r.id join nw on nw.scope = r.scope),
d1 as (select *, sup is null and not arch and coalesce(storageStrength, 0) < 0.9 and coalesce(greatest(0.0, coalesce(retrievalStrength, 0) - greatest(0, now - turn) * 0.012) < 0.15 and now - turn > 30, false) newarch from d0),
d2 as (select *, sup is null and not arch and not newarch active from d1),
d as (select *, active and na >= 2 and not coalesce(metadata.promotionCandidate, false) promoted from d2)"""
_SUBJ = r"trim(regexp_replace(lower({0}), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', ' ', 'g'))"
_KEY = r"nullif(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '#c\d+$', ''), '')"
_TASK = _SUBJ.format("coalesce(taskref, regexp_extract(content, '^task (completed|blocked): (.+)$', 2))")
_CLEAN = "list_distinct(list_filter({0}, lambda x: x is not null and trim(x) <> ''))"
_MEMBERS = f"""m as (select distinct part, 'task' k, trim(taskref) g, id from pg where trim(taskref) <> '' union select part, 'file', unnest({_CLEAN.format("list_concat([path], coalesce(paths, []))")}), id from pg union select part, 'source', unnest({_CLEAN.format('coalesce(sourceRefs, [])')}), id from pg),
adj as (select part, id, layer = 'L0' and kind = 'episodic' e, lead(id) over w to_, lead(layer = 'L0' and kind = 'episodic') over w te from pg window w as (partition by part order by turn, id)),
ed as (select distinct a.part, a.id src, b.id dst, a.k as kind from m a join m b on a.part = b.part and a.k = b.k and a.g = b.g and a.id < b.id
  union select s.part, least(s.id, t.id), greatest(s.id, t.id), 'supersede' from pg s join pg t on s.part = t.part and lower(trim(s.supersededBy)) = t.id and s.id <> t.id
  union select part, least(id, to_), greatest(id, to_), 'adjacent' from adj where e and te),
edges as (select *, case kind when 'task' then 0.6::double when 'supersede' then 0.8 else 0.5 end weight from ed)"""
SQL = {
    "duplicate_marks": f"with {_R}, {_DUP} select id, keeper from mark",
    "dream_report": _DREAM + " select scope, count(*) scanned, count(keeper) deduped, count(*) filter (where newarch) archived, count(*) filter (where promoted) promotion_candidates, count(*) filter (where active) active from d group by 1",
    "dream_governance": _DREAM + " select id, sup superseded_by, newarch archived, promoted promotion from d where keeper is not null or newarch or promoted",
    "supersession": f"with {_R} select * from (select id, topic, lead(id) over (partition by topic order by ingested_at, id) successor from r where topic is not null and layer in ('L1', 'L2')) where successor is not null",
    "task_patterns": f"""with {_R}, f as (select id, scope, regexp_extract(content, '^task (completed|blocked): (.+)$', 1) kind, {_SUBJ.format("regexp_extract(content, '^task (completed|blocked): (.+)$', 2)")} subject from r),
g as (select subject, count(*) filter (where kind = 'completed') success, count(*) filter (where kind = 'blocked') failure, min(id) first_id, count(distinct scope) n_scopes from f where kind <> '' and subject <> '' group by 1)
select *, case when failure >= 2 and success < 3 then 'failing' when success >= 3 and failure < 2 then 'reliable' else 'mixed' end status from g where success >= 3 or failure >= 2""",
    "task_recall": f"with {_R} select case when layer = 'L2' then 0 else 1 end section, id, turn from r where {_TASK} = 'fix the alias table' and supersededBy is null",
    "persona": f"""with {_R}, nw as (select scope, max(turn) + 1 as now from r group by 1), h as ({' union all '.join(f"select scope, turn, {S.lit(d)} domain from r where supersededBy is null and trim(content) <> '' and {S.matches('lower(content)', p)}" for d, p in V.DOMAINS.items())}),
g as (select scope, domain, count(*) n, max(turn) last_turn from h group by 1, 2), c as (select g.*, ln(1 + n) * (0.7 + 0.3 * case when now > 0 then greatest(0.0, 1 - (now - last_turn) / now::double) else 0 end) c from g join nw using (scope))
select scope, domain, n, last_turn, place, round(c, 6) confidence from (select *, row_number() over (partition by scope order by round(c, 9) desc, domain) place from c) where place <= 6""",
    "consolidation_candidates": f"""with {_R}, used as (select distinct {_KEY.format('ref')} id from (select unnest(coalesce(metadata.consolidatedIds, sourceRefs)) ref from r)),
c as (select scope, id, turn, case when len(coalesce(accessLog, [])) + len(coalesce(turns, [])) > 0 then 0 when category in ('lesson', 'error') then 1 else 2 end priority from r left join acc using (id) where supersededBy is null and not arch and coalesce(metadata.origin, '') <> 'consolidation' and id not in (select id from used where id is not null))
select scope, id, priority, place from (select *, row_number() over (partition by scope order by priority, turn desc, id) place from c) where place <= 40""",
    "deep_selection": f"""with {_R}, a as (select *, {_TASK} task from r where supersededBy is null), enough as (select task from a where layer = 'L0' and task <> '' group by 1 having count(*) >= 3),
u as (select 'verify' as action, scope, id, row_number() over (partition by scope order by id) place, 3 k from a where layer = 'L1' and not coalesce(metadata.verified, false)
 union all select 'enrich', scope, id, row_number() over (partition by scope order by id), 2 from a where layer = 'L2' and not coalesce(metadata.enriched, false) and task in (select task from enough)
 union all select 'reactivate', scope, id, row_number() over (partition by scope order by id), 4 from a where arch and len(list_intersect({S.tokens("'prompt cache and vector cache retries'")}, {S.tokens('content')})) > 0)
select action, scope, id, place from u where place <= k""",
    "source_texts": f"""with {_R}, e as (select id, unnest(k) ref, generate_subscripts(k, 1) i from (select id, list_filter(list_transform(sourceRefs, lambda x: {_KEY.format('x')}), lambda x: x is not null) k from r where layer in ('L1', 'L2'))),
j as (select e.id, e.i, l.content from e left join r l on l.id = e.ref and l.layer = 'L0')
select id, count(*) n_refs, count(content) n_found, md5(left(coalesce(string_agg(content, ' | ' order by i), ''), 2000)) digest from j group by 1""",
    "provenance": f"""with {_R}, d as (select id, unnest(case when len(sourceRefs) > 0 then sourceRefs else [null] end) ref from r where layer in ('L1', 'L2')), k as (select d.id, {_KEY.format('ref')} ref from d), j as (select k.id, k.ref, l.id ok from k left join r l on l.id = k.ref and l.layer = 'L0')
select id, count(ref) n_refs, count(ok) n_known from j group by 1 having count(ref) = 0 or count(ok) < count(ref)""",
    "goal_chain": f"""with {_R}, g as (select scope, id, metadata.focusKey focus, turn from r where trim(metadata.focusKey) <> ''), k as (select *, lag(focus) over (partition by scope order by turn, id) b from g)
select scope, id, focus, lag(id) over w supersedes, lead(id) over w is null active from k where b is null or b <> focus window w as (partition by scope order by turn, id)""",
    "working_state": rf"""with {_R}, k as (select scope, turn, content, case when list_contains(tags, 'todo:blocked') then 'blocked' when list_contains(tags, 'todo:completed') then 'done' when list_contains(tags, 'file-op') then 'files' when category in ('lesson', 'error') then 'lessons' when category = 'preference' then 'preferences' end l from r where supersededBy is null),
i as (select scope, l, turn, case when l = 'files' then nullif(regexp_extract(content, '([\w.\-]+(?:/[\w.\-]+)+\.\w+)', 1), '') else left(trim(regexp_replace(trim(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')[1]), '\s+', ' ', 'g')), 120) end item from k where l is not null),
o as (select scope, l, item, max(turn) turn from i where item is not null group by 1, 2, 3), t as (select *, row_number() over (partition by scope, l order by turn desc, item) n from o)
select scope, l "list", string_agg(item, '; ' order by item) items, count(*) n from t where n <= 64 group by 1, 2""",
    "status_counts": f"with {_R} select scope, count(*) filter (where layer = 'L0') evidence, count(*) filter (where arch) archived, count(*) filter (where layer = 'L1') facts, count(*) filter (where layer = 'L2') procedures, count(*) filter (where id in (select id from access_log where id is not null)) accessed from r group by 1",
    "graph_edges": f"with {_R}, pg as (select *, scope part, metadata.path path, metadata.paths paths from r), {_MEMBERS} select part as scope, src, dst, kind, weight from edges",
    "spread_activation": f"""with {S.POOL}, pg as (select *, query_id part from pool), {_MEMBERS}, {S.ranked(V.WEIGHTS_CONTEXT)},
seeds as (select query_id part, id, score energy from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) pos from scored) where pos <= 3 and round(score, 9) >= 0.28),
ways as (select part, src id, dst to_, weight from edges union all select part, dst, src, weight from edges),
h1 as (select s.part, to_ id, sum(energy * weight * 0.5) energy from seeds s join ways w on w.part = s.part and w.id = s.id group by 1, 2),
h2 as (select s.part, to_ id, sum(energy * weight * 0.5) energy from h1 s join ways w on w.part = s.part and w.id = s.id group by 1, 2),
t as (select part, id, sum(energy) energy from (select * from h1 union all select * from h2) group by 1, 2)
select part query_id, id, place, round(energy, 6) energy from (select *, row_number() over (partition by part order by round(energy, 9) desc, id) place from t where round(energy, 9) >= 0.15 and not exists (select 1 from seeds s where s.part = t.part and s.id = t.id)) where place <= 4""",
    "similar_edges": f"""with {S.POOL}, {recall._VEC}, v as (select query_id, pool.id, lead::double[] v from pool join rep using (id)), u as (select *, sqrt(list_dot_product(v, v)) n from v)
select a.query_id, a.id src, b.id dst, round(list_dot_product(a.v, b.v) / a.n / b.n, 5) weight from u a join u b on a.query_id = b.query_id and a.id < b.id and len(a.v) = len(b.v) where a.n > 0 and b.n > 0 and list_dot_product(a.v, b.v) / a.n / b.n >= 0.75""",
}
