"""Queries that write a store, read it back and say what came out, and those of model replies; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import render, text
from palimpsest.operators import ingest, rank, replies
from palimpsest.plans import ingest as ingest_plans
from palimpsest.plans import search
from palimpsest.plans import sqlparts as S
from palimpsest.runtime import shared_dir, table
from palimpsest.sources import jsonl, sinks
from palimpsest.sources.records import notes, records


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored row, written as JSON lines by layer and read back through the schema gate: rows of each scope,
    of all layers and of each derived one."""
    path = _folder(spark)
    jsonl.write_records(table(spark, sf_dir, "memory_record").drop("ingested_at"), path)
    count = lambda part, layer: jsonl.read_written(spark, path, layer).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars")).select(F.lit(part).alias("part"), "*")
    return count("all", None).unionByName(count("L1", "L1")).unionByName(count("L2", "L2"))


def todo_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To-do lists saved as snapshots, one of each document, and restored."""
    path = _folder(spark)
    items = ingest_plans.todo_items(spark, sf_dir)
    one = F.struct(F.col("num").cast("int").alias("num"), "subject", "status")
    snapshots = items.groupBy("doc_id").agg(F.to_json(F.struct(F.lit(1).alias("schema"), F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("i")))), lambda x: x["i"]).alias("items"))).alias("value"))
    snapshots.select("value").write.text(path)
    return jsonl.read_todo_snapshot(spark, path, whole_files=False).groupBy("status", "subject").agg(F.count(F.lit(1)).alias("n"))


def notes_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of notes appended to a file of each scope, and the folder read back as notes."""
    path = _folder(spark)
    lines = notes(spark, sf_dir, ["id", "scope", "content"]).where(F.trim("content") != "").select(F.col("scope").alias("category"), F.element_at(F.split("content", "\n"), 1).alias("line"), F.col("id").alias("seq"))
    sinks.write_notes(sinks.note_lines(lines), path)
    return jsonl.read_notes(spark, path).select("id", "note_file", F.md5("content").alias("digest"))


def derived_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived rows offered to a store of evidence: refused ones, and which row supersedes which."""
    rows = records(spark, sf_dir, {"id": F.col("id"), "scope": F.col("scope"), "layer": F.col("layer"), "topic": F.col("metadata.topicKey"), "sourceRefs": F.col("sourceRefs"), "seq": F.col("turn")})
    known = rows.where(F.col("layer") == "L0").select("id")
    offered = rows.where(F.col("layer") != "L0")
    after, refused = sinks.upsert_derived(offered.limit(0).withColumn("supersededBy", F.lit(None).cast("string")), offered, known)
    return after.select("id", F.lit(False).alias("refused"), "supersededBy").unionByName(refused.select("id", F.lit(True).alias("refused"), F.lit(None).cast("string").alias("supersededBy")))


def patched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purged records archived by a patch; ids of no record change nothing."""
    rows = records(spark, sf_dir, ["id", "archived", "storageStrength"])
    p = table(spark, sf_dir, "purged_id").select("id").distinct().select("id", F.lit(True).alias("archived"), F.lit(None).cast("double").alias("storageStrength"))
    return sinks.patch(rows, p, ["archived", "storageStrength"])


def version_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence consolidated into a new version: readers see the whole last one."""
    path = _folder(spark)
    rows = records(spark, sf_dir, ["id", "scope", "layer"])
    sinks.replace_version(rows, path)
    sinks.replace_version(rows.where(F.col("layer") == "L0"), path)
    return sinks.current_version(spark, path).groupBy("scope", "layer").agg(F.count(F.lit(1)).alias("n"))


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = {"id": F.col("id"), "layer": F.col("layer"), "kind": F.col("kind"), "content": F.col("content"), "sourceRefs": F.col("sourceRefs"), "topic": F.col("metadata.topicKey"), "tags": F.col("tags"), "archived": F.col("archived")}
    return records(spark, sf_dir, keep).where((F.col("layer") != "L0") & F.col("content").isNotNull())


def reply_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact cards read from replies that say them in a fenced block between other words."""
    d = _derived(spark, sf_dir)
    card = F.struct(F.col("content").alias("fact"), F.col("topic").alias("topicKey"), F.upper("kind").alias("category"), F.col("sourceRefs").alias("sourceIds"))
    said = d.select(F.col("id").alias("reply_id"), F.concat(F.lit("Here they are.\n```json\n"), F.to_json(F.struct(F.array(card).alias("facts"))), F.lit("\n```\nThat is all.")).alias("reply"))
    cards = replies.fact_cards(said, records(spark, sf_dir, ["id"]))
    return cards.select("reply_id", "kind", F.md5("fact").alias("fact"), "topic", "category", F.size("sourceIds").alias("n_sources"))


def reply_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts, steps and reactivations read from bare replies."""
    d = _derived(spark, sf_dir).withColumn("verdict", F.when(F.coalesce("archived", F.lit(False)), "UNSUPPORTED").otherwise("supported"))
    body = F.struct(
        F.array(F.struct("id", "verdict"), F.struct(F.lit(None).cast("string").alias("id"), F.lit("supported").alias("verdict")), F.struct(F.lit("x").alias("id"), F.lit("perhaps").alias("verdict"))).alias("verdicts"),
        F.array(F.struct("id", F.col("tags").alias("steps"))).alias("steps"),
        F.array("id", "id").alias("reactivate"),
    )
    said = d.select(F.col("id").alias("reply_id"), F.to_json(body).alias("reply"))
    row = lambda df, what, value: df.select(F.lit(what).alias("what"), "reply_id", "id", value.alias("value"))
    return row(replies.verdicts(said), "verdict", F.col("verdict")).unionByName(row(replies.steps(said), "steps", F.array_join("steps", "|"))).unionByName(row(replies.reactivations(said), "reactivate", F.lit("")))


def response_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of completions: a string, or the text blocks among others."""
    d = _derived(spark, sf_dir)
    block = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    blocks = F.to_json(F.struct(F.array(block("text", F.col("content")), block("tool", F.lit("x")), block("text", F.col("kind"))).alias("content")))
    plain = F.to_json(F.struct(F.col("content").alias("content")))
    said = d.select("id", "layer", F.when(F.col("layer") == "L1", plain).otherwise(blocks).alias("response"))
    return said.select("id", F.md5(replies.response_text(F.col("response"))).alias("digest"))


def tool_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of tool calls, made of the paths that records name."""
    r = records(spark, sf_dir, {"id": F.col("id"), "turn": F.col("turn"), "path": F.col("metadata.path"), "layer": F.col("layer")})
    args = F.to_json(F.struct(F.lit(" ").alias("path"), F.col("path").alias("file_path")))
    calls = r.select(F.col("id").alias("session"), "turn", F.when(F.col("layer") == "L0", "edit").when(F.col("layer") == "L1", "write").otherwise("read").alias("tool"), args.alias("args"))
    return ingest.file_operations(calls).select("session", "turn", "path", "content", "ss", "rs")


def error_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error texts cut to whole lines."""
    r = records(spark, sf_dir, ["id", "content"]).where(F.trim("content") != "")
    return r.select("id", F.md5(ingest.error_text(F.col("content"), 300)).alias("digest"))


def session_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three records of each session in which the user says most, 90 of a scope, in turn order."""
    r = records(spark, sf_dir, {"id": F.col("id"), "scope": F.col("scope"), "turn": F.col("turn"), "session": F.col("metadata.sessionId"), "content": F.col("content"), "layer": F.col("layer")})
    rows = r.where((F.col("layer") == "L0") & (F.trim("content") != "") & (text.user_share(F.col("content")) > 0.6))
    return rank.session_sample(rows, ["scope"], "session", ["turn", "id"]).select("scope", "id", "number")


def xml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each question's first 20 records by category, semantic before episodic before core, within 6 000 characters."""
    ranked = search.hybrid_rank(spark, sf_dir).where(F.col("pos") <= 20).select("query_id", "id", "pos")
    r = records(spark, sf_dir, {"id": F.col("id"), "layer": F.col("layer"), "tags": F.col("tags"), "content": F.col("content"), "date": F.col("metadata.date")})
    return render.xml_facts(ranked.join(r, "id"), ["query_id"], "pos").select("query_id", "id", "category", "number", F.md5("line").alias("digest"))


_ALL = (jsonl_scan, todo_snapshot, notes_folder, derived_upsert, patched_records, version_swap, reply_cards, reply_judgements, response_texts, tool_evidence, error_evidence, session_sample, xml_lines)
QUERIES = {f.__name__: f for f in _ALL}

_DERIVED = f"(select * from {S.REC} where layer <> 'L0' and content is not null)"
_TRIM = lambda x: rf"trim({x}, ' ')"
SQL = {
    "jsonl_scan": "with r as (select * from memory_record where schema = 1) select 'all' part, scope, count(*) n, sum(length(content)) chars from r group by scope union all select layer, scope, count(*), sum(length(content)) from r where layer in ('L1', 'L2') group by layer, scope",
    "todo_snapshot": f"select status, subject, count(*) n from ({ingest_plans.SQL['todo_items']}) group by 1, 2",
    "notes_folder": f"""with n as (select regexp_replace(trim(lower(scope)), '[^\\w\\-]+', '-', 'g') f, scope, id, string_split(content, chr(10))[1] line from {S.NOTE} where trim(content) <> '')
select 'note:' || f id, f || '.md' note_file, md5('# ' || scope || chr(10) || string_agg('- ' || line, chr(10) order by id) || chr(10)) digest from n group by f, scope""",
    "derived_upsert": f"""with r as (select id, scope, layer, metadata.topicKey topic, sourceRefs, turn seq from {S.REC}), k as (select id from r where layer = 'L0'), o as (select * from r where layer <> 'L0'),
refs as (select id, unnest(sourceRefs) ref from o), j as (select o.id, count(refs.ref) n, count(k.id) known from o left join refs on refs.id = o.id left join k on k.id = refs.ref group by 1),
ok as (select o.*, n > 0 and n = known fine from o join j using (id)), s as (select id, case when topic is not null then lead(id) over (partition by scope, topic order by seq nulls first, id) end next from ok where fine)
select id, false refused, next "supersededBy" from s union all select id, true, null from ok where not fine""",
    "patched_records": f"""select id, case when id in (select id from purged_id where id is not null) then true else archived end archived, "storageStrength" from {S.REC}""",
    "version_swap": f"select scope, layer, count(*) n from {S.REC} where layer = 'L0' group by 1, 2",
    "reply_cards": f"""with d as (select * from {_DERIVED} where {_TRIM('content')} <> ''), refs as (select id, unnest(sourceRefs) ref from d), ok as (select refs.id, count(*) n, count(r.id) k from refs left join {S.REC} r on r.id = refs.ref group by 1),
c as (select d.*, lower({_TRIM("coalesce(metadata.topicKey, '')")}) t, lower(kind) cat from d join ok on ok.id = d.id where n = k)
select id reply_id, 'fact' kind, md5(substr({_TRIM('content')}, 1, 500)) fact, coalesce(nullif(substr(regexp_replace(regexp_replace(t, '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64), ''), 'fact') topic, case when cat in ('fact', 'preference', 'lesson', 'error', 'state', 'decision') then cat else 'fact' end category, len(sourceRefs)::int n_sources from c""",
    "reply_judgements": f"""with d as {_DERIVED} select 'verdict' what, id reply_id, id, case when coalesce(archived, false) then 'unsupported' else 'supported' end as value from d
union all select 'steps', id, id, array_to_string(s, '|') from (select id, list_filter(list_transform(tags, lambda x: trim(x, ' ')), lambda x: x <> '') s from d) where len(s) > 0 union all select 'reactivate', id, id, '' from d""",
    "response_texts": f"select id, md5(case when layer = 'L1' then content else concat_ws(chr(10), content, kind) end) digest from {_DERIVED}",
    "tool_evidence": f"""select id as session, turn, p path, case when layer = 'L1' then 'wrote ' else 'edited ' end || p as content, 0.4::double ss, 0.5::double rs from (select *, substr(trim(metadata.path, ' '), 1, 240) p from {S.REC} where layer in ('L0', 'L1') and trim(metadata.path, ' ') <> '')""",
    "error_evidence": f"""with l as (select id, unnest(string_split(content, chr(10))) x, generate_subscripts(string_split(content, chr(10)), 1) i from {S.REC} where trim(content, ' ') <> ''),
c as (select *, sum(length(x) + 1) over (partition by id order by i) - 1 cum from l) select id, md5(string_agg(x, chr(10) order by i)) digest from c where i = 1 or cum <= 300 group by id""",
    "session_sample": f"""with h as (select * from ({ingest_plans.SQL['user_share']}) where user_heavy), r as (select r.id, r.scope, r.turn, r.metadata.sessionId s from {S.REC} r join h on h.id = r.id),
one as (select *, row_number() over (partition by scope, coalesce(s, '?') order by turn nulls first, id) i from r), n as (select *, row_number() over (partition by scope order by turn nulls first, id)::int as number from one where i <= 3)
select scope, id, number from n where number <= 90""",
    "xml_lines": f"""with h as (select query_id, id, pos place from ({search.SQL['hybrid_rank']}) where pos <= 20), r as (select h.*, case when layer = 'L1' and list_contains(coalesce(tags, []), 'persona') then 'core' when layer = 'L1' then 'semantic' else 'episodic' end category, metadata.date d,
trim(regexp_replace(regexp_replace(content, '^\\[\\d{{4}}-\\d{{2}}-\\d{{2}}\\]\\s*\\(session [^)]+\\)\\n', ''), '^(user|assistant):\\s*', '', 'i'), ' ' || chr(9) || chr(10) || chr(13)) body from h join {S.REC} x on x.id = h.id),
f as (select *, case when d is not null and d <> '' then '[' || string_split(d, ' ')[1] || '] ' else '' end || substr(string_split_regex(body, '[.!?]\\s')[1], 1, 200) fact from r),
o as (select *, '    -' || fact line, case category when 'semantic' then 1 when 'episodic' then 2 else 3 end c from f where length(fact) >= 5),
n as (select *, row_number() over (partition by query_id order by c, place)::int as number, sum(length(line)) over (partition by query_id order by c, place) used from o)
select query_id, id, category, number, md5(line) digest from n where 20 + used + 30 <= 6000""",
}
