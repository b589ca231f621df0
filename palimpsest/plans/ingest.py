"""Queries of sources, ingestion and text functions, with their SQL.

Session logs, to-do exports, summaries and seeds are read from `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import score, temporal, text
from palimpsest.functions import vocabulary as V
from palimpsest.operators import ingest, rank
from palimpsest.plans import maintenance
from palimpsest.plans import sqlparts as S
from palimpsest.runtime import table, utc_month
from palimpsest.sources import sinks
from palimpsest.sources.records import notes, records


def docs(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    key = F.regexp_replace(F.lower(F.trim("source")), "_", "-")
    return table(spark, sf_dir, "documents").where((key == source) & (F.trim("text") != ""))


def lines(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    d = docs(spark, sf_dir, source)
    return d.select("doc_id", "scope", "session_id", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("pos", "line"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role lines of session logs as messages; each document is a session of its own."""
    raw = docs(spark, sf_dir, "session-log").withColumn("date", ingest.header_date(F.col("text")))
    each = raw.select(F.col("doc_id").cast("string").alias("session"), "date", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("pos", "line"))
    role = F.lower(F.regexp_extract("line", r"(?i)^(user|assistant):\s?", 1))
    return each.where(role != "").select("session", "date", "pos", role.alias("role"), F.regexp_replace("line", r"(?i)^(user|assistant):\s?", "").alias("content"))


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by scope and layer after the schema gate and the removal of replays."""
    r = records(spark, sf_dir, ["id", "scope", "layer", "content", "supersededBy", "archived", "turn"])
    active = F.col("supersededBy").isNull() & (F.trim("content") != "")
    return r.groupBy("scope", "layer").agg(F.count(F.lit(1)).alias("n"), F.count_if(active).alias("active"), F.count_if(active & ~F.coalesce("archived", F.lit(False))).alias("open"), F.max("turn").alias("turns"), F.sum(F.length("content")).alias("chars"))


def scopes_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 80 scopes written to last: a listing's limit."""
    r = records(spark, sf_dir, ["id", "scope", "content", "ingested_at"])
    g = r.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"), F.max("ingested_at").alias("last"))
    return g.orderBy(F.col("last").desc(), "scope").limit(80).select("scope", "n", "chars", utc_month(F.col("last")).alias("month"))


def peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten records of each scope by turn: a peek's limit."""
    r = records(spark, sf_dir, ["id", "scope", "turn", "content"])
    return r.withColumn("pos", F.row_number().over(W.partitionBy("scope").orderBy("turn", "id"))).where(F.col("pos") <= 10).select("scope", "pos", "id", "turn", F.length("content").alias("chars"))


def access_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = rank.fold_access(table(spark, sf_dir, "access_log"))
    return f.select("id", F.size("extra").alias("n"), F.array_join(F.transform("extra", lambda x: x.cast("string")), ",").alias("turns"))


def access_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strengths of evidence after its accesses."""
    r = maintenance.store(spark, sf_dir).where(F.col("layer") == "L0")
    now = r.groupBy("scope").agg((F.max("turn") + 1).alias("now"))
    a = rank.with_access(r.join(now, "scope"), rank.fold_access(table(spark, sf_dir, "access_log")), F.col("now"))
    return a.select("id", F.round("ss", 6).alias("ss"), F.round("rs", 6).alias("rs"), F.coalesce(F.size("log"), F.lit(0)).alias("n"), F.round(score.base_level(F.col("log"), F.col("now")), 6).alias("activation"))


def strength_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = maintenance.store(spark, sf_dir)
    now, n = F.col("turn") + 25, F.size(F.coalesce("accessLog", F.array().cast("array<bigint>")))
    bla = score.base_level(F.col("accessLog"), now)
    return r.select("id", F.round(score.retrieval_strength(F.col("retrievalStrength"), F.col("turn"), now), 6).alias("rs"), F.round(bla, 6).alias("bla"), (bla >= 0).alias("retrieved"), F.round(score.latency(bla), 6).alias("latency"), F.round(score.mismatch(F.col("storageStrength")), 6).alias("mismatch"), score.semantic_chars(F.length("content").cast("double"), n).cast("int").alias("shown"), text.turn_age(now - F.col("turn") + F.length("content") % 30 - 25).alias("age"))


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = maintenance.store(spark, sf_dir).withColumn("session", F.lit(None).cast("string"))
    c = F.col("content")
    return r.select("id", F.md5(text.meaning_key(c)).alias("meaning"), text.task_subject(F.coalesce("taskref", F.lit(""))).alias("task"), text.slug(F.coalesce("topic", F.lit("")), prefix="ledger-").alias("slug"), text.trace_id(F.col("session"), c).alias("trace"), F.md5(text.headline(c)).alias("headline"), F.md5(text.first_line(c)).alias("first"), text.content_path(c).alias("path"), text.safe_name(F.col("scope")).alias("safe"), text.record_id(F.col("scope"), F.col("id")).alias("hash"), F.size(text.tokens(c)).alias("tokens"))


def user_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir, ["id", "content", "layer"]).where((F.col("layer") == "L0") & (F.trim("content") != ""))
    share = text.user_share(F.col("content"))
    return r.select("id", F.round(share, 6).alias("share"), (share > 0.6).alias("user_heavy"), F.round(score.self_reference(F.lit("temporal"), share), 6).alias("factor"))


def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir, {"id": F.col("id"), "date": F.col("metadata.date"), "ingested_at": F.col("ingested_at")})
    return r.select("id", temporal.date_key(F.col("date")).alias("date_key"), F.date_format(temporal.record_date(F.col("date")), "yyyy-MM-dd").alias("record_date"), temporal.epoch_date(F.unix_millis("ingested_at")).alias("day"), temporal.epoch_date(F.unix_seconds("ingested_at")).alias("day_s"))


def note_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir, {"id": F.col("id"), "content": F.col("content"), "tags": F.col("tags"), "mtime": F.col("metadata.mtimeMs")}).where(F.trim("content") != "")
    office = F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, V.OFFICE_TAGS)))
    return n.select("id", F.md5(F.concat(F.lit("note: "), "content")).alias("content"), F.when(office, 0.9).otherwise(0.7).alias("ss"), text.note_age(F.col("mtime"), F.lit(1782000000000)).alias("age"))


def ingest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ingest.stitch(messages(spark, sf_dir).drop("date"))
    dates = messages(spark, sf_dir).groupBy("session").agg(F.min("date").alias("date"))
    turned = m.join(dates, "session").withColumn("turn", F.lit(1))
    out = ingest.ingest(turned)
    return out.select("id", "session", "date", F.length("content").alias("chars"), F.md5("content").alias("digest"))


def todo_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.todo_items(lines(spark, sf_dir, "todo-export")).select("doc_id", "pos", "num", "subject", "status")


def todo_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.todo_facts(ingest.todo_items(lines(spark, sf_dir, "todo-export")), ["scope"])


def todo_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.todo_anchor(ingest.todo_items(lines(spark, sf_dir, "todo-export")), ["doc_id"])


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 8)
    return d.select("doc_id", F.posexplode(text.corrections(F.col("text"))).alias("i", "correction"))


def persona_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.seeds(lines(spark, sf_dir, "persona-seed")).select("doc_id", "pos", "facet", "seed")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir, ["id", "content"]).where(F.col("content").isNotNull())
    return r.select("id", F.explode(text.facts(F.col("content"))).alias("fact"))


def summary_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sections(docs(spark, sf_dir, "compaction").select("doc_id", "text"), ["doc_id"]).select("doc_id", "section", "name", "i", F.trim("line").alias("line"))


def summary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two summaries of each scope merged: the scope's newest with the one before."""
    d = docs(spark, sf_dir, "compaction").withColumn("age", F.row_number().over(W.partitionBy("scope").orderBy(F.col("created_at").desc(), F.col("doc_id").desc()))).where(F.col("age") <= 2)
    s = ingest.sections(d.select("scope", "age", "text"), ["scope", "age"]).withColumn("line", F.trim("line"))
    cols = ["scope", "name", "i", "line"]
    return ingest.merged_sections(s.where(F.col("age") == 2).select(*cols), s.where(F.col("age") == 1).select(*cols), ["scope"], ("Goal", "Notes"), ("Goal", "Working state", "Notes", "Evidence"))


def summary_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir, "compaction")
    has = lambda s: F.contains("text", F.lit(f"[{s}]"))
    return d.select("doc_id", has("Goal").alias("goal"), has("Working state").alias("state"), (has("Goal") & has("Working state") & has("Notes")).alias("complete"))


def embedding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir, ["id", "content"]).where(F.trim("content") != "")
    return ingest.record_chunks(r).select("id", "key", "chunk", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir, ["id", "content"]).where(F.trim("content") != "")
    return ingest.cache_misses(ingest.record_chunks(r), table(spark, sf_dir, "vector_entry").where(F.size("vec") > 0))


def current_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sinks.latest(table(spark, sf_dir, "vector_entry").where(F.col("key").isNotNull()), ["key"], "seq", ["scope", "vec"])
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return v.where((F.size("vec") == 64) & ~F.exists("vec", F.isnan)).select("key", F.regexp_replace("key", r"#c\d+$", "").alias("id"), F.round(F.sqrt(norm), 4).alias("norm"))


def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that appending the year's second half to the first would add."""
    raw = table(spark, sf_dir, "memory_record").where((F.col("schema") == 1) & F.col("id").isNotNull()).select("id", "scope", "turn", utc_month(F.col("ingested_at")).alias("month"), "ingested_at")
    old, new = raw.where(F.col("month") < "2025-07"), raw.where(F.col("month") >= "2025-07")
    return sinks.new_rows(new, old, ["id"], ["ingested_at"]).select("id", "scope", "month")


def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the open part of the metadata, tolerant of text that is no JSON."""
    r = records(spark, sf_dir, {"id": F.col("id"), "extra": F.col("metadata.extra")}).where(F.col("extra").isNotNull())
    parsed = F.from_json("extra", "sourceSession string, promoted boolean")
    return r.select("id", parsed["sourceSession"].alias("source_session"), F.coalesce(parsed["promoted"], F.lit(False)).alias("promoted"))


QUERIES = {f.__name__: f for f in (source_counts, scopes_listing, peek, access_fold, access_feedback, strength_functions, text_functions, user_share, date_functions, note_records, ingest_messages, todo_items, todo_facts, todo_anchor, corrections, persona_seeds, facts, summary_sections, summary_merge, summary_valid, embedding_chunks, cache_misses, current_vectors, idempotent_append, metadata_json)}

_MONTH = "strftime({0}::timestamptz at time zone 'UTC', '%Y-%m')"


def _docs(source: str) -> str:
    return f"(select * from documents where regexp_replace(lower(trim(source)), '_', '-', 'g') = '{source}' and trim(text) <> '')"


def _lines(source: str) -> str:
    t = "string_split(replace(text, chr(13), ''), chr(10))"
    return f"(select doc_id, scope, created_at, unnest({t}) line, generate_subscripts({t}, 1) - 1 pos from {_docs(source)})"


_ITEMS = rf"""l as {_lines('todo-export')}, ti as (select *, regexp_extract(line, '^\s*([○◯◐◓◑✓✔✗✖⊘])\s*#(\d+)\s+(.{{1,120}}?)\s*$', 1) mark, regexp_extract(line, '^\s*([○◯◐◓◑✓✔✗✖⊘])\s*#(\d+)\s+(.{{1,120}}?)\s*$', 2) num, trim(regexp_extract(line, '^\s*([○◯◐◓◑✓✔✗✖⊘])\s*#(\d+)\s+(.{{1,120}}?)\s*$', 3)) raw from l),
items as (select doc_id, scope, pos, num::int num, case when regexp_matches(raw, '(?i)\s*[-–—]\s*blocked\b.*$') then trim(regexp_replace(raw, '(?i)\s*[-–—]\s*blocked\b.*$', '')) else raw end subject,
  case when regexp_matches(raw, '(?i)\s*[-–—]\s*blocked\b.*$') or mark in ('✗', '✖', '⊘') then 'blocked' when mark in ('○', '◯') then 'pending' when mark in ('◐', '◓', '◑') then 'in_progress' else 'completed' end status from ti where mark <> '')"""
_HASH = "'mem_' || left(sha256(concat_ws(chr(31), {0})), 24)"
_SECT = r"""sl as (select *, nullif(regexp_extract(line, '^\[([^\]]+)\]\s*$', 1), '') head from ln), sc as (select *, count(head) over (partition by {k} order by pos) section, last_value(head ignore nulls) over (partition by {k} order by pos) name from sl),
sections as (select * from sc where section > 0 and head is null and trim(line) <> '')"""
SQL = {
    "source_counts": f"select scope, layer, count(*) n, count(*) filter (where supersededBy is null and trim(content) <> '') active, count(*) filter (where supersededBy is null and trim(content) <> '' and not coalesce(archived, false)) as open, max(turn) turns, sum(length(content))::bigint chars from {S.REC} group by 1, 2",
    "scopes_listing": f"select scope, n, chars, {_MONTH.format('last_')} as month from (select scope, count(*) n, sum(length(content))::bigint chars, max(ingested_at) last_ from {S.REC} group by 1 order by last_ desc, scope limit 80)",
    "peek": f"select scope, pos, id, turn, length(content) chars from (select *, row_number() over (partition by scope order by turn, id) pos from {S.REC}) where pos <= 10",
    "access_fold": f"select id, len(turns) n, array_to_string(turns, ',') turns from {S.ACC}",
    "access_feedback": f"""with r as (select * from {S.REC} where layer = 'L0'), nw as (select scope, max(turn) + 1 as now from r group by 1), a as (select r.id, coalesce(storageStrength, 0) ss0, coalesce(retrievalStrength, 0) rs0, turn, accessLog own, turns extra, now from r join nw using (scope) left join {S.ACC} x on x.id = r.id),
b as (select id, now, case when len(extra) > 0 then least(1.0, ss0 + 0.05 * len(extra)) else ss0 end ss, case when len(extra) > 0 then greatest(rs0, greatest(0.0, 1 - greatest(0, now - greatest(turn, list_max(extra))) * 0.012)) else rs0 end rs, case when len(extra) > 0 then list_slice(list_concat(own, extra), -32, -1) else own end log from a)
select id, round(ss, 6) ss, round(rs, 6) rs, coalesce(len(log), 0) n, round({S.bla('log', 'now')}, 6) activation from b""",
    "strength_functions": f"""with b as (select id, content, turn, turn + 25 as now, coalesce(storageStrength, 0) ss, coalesce(retrievalStrength, 0) rs0, coalesce(accessLog, []) log from {S.REC}), c as (select *, {S.bla('log', 'now')} bla, 25 + length(content) % 30 - 25 age0 from b)
select id, round({S.rs_at('rs0', 'turn', 'now')}, 6) rs, round(bla, 6) bla, bla >= 0 retrieved, round(0.1 * exp(-bla), 6) latency, round(ss - 1, 6) mismatch, (case when len(log) <= 0 or length(content) <= 0 then length(content) else greatest(20, floor(length(content) * (0.5 + 0.5 / (1 + len(log) * 0.15)) + 0.5)) end)::int shown,
 case when age0 < 3 then '' when age0 <= 5 then '~3 turns ago' when age0 <= 10 then '~6 turns ago' when age0 <= 20 then '~10 turns ago' when age0 <= 40 then '~20 turns ago' when age0 is not null then '>40 turns ago' else '>40 turns ago' end age from c""",
    "text_functions": rf"""select id, md5(trim(regexp_replace(regexp_replace(lower(content), '\s+', ' ', 'g'), '[.。,，!！?？;；:：]+', '', 'g'))) meaning, trim(regexp_replace(lower(coalesce(metadata.taskRef, '')), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', ' ', 'g')) task,
 'ledger-' || coalesce(nullif(left(regexp_replace(regexp_replace(lower(coalesce(metadata.topicKey, '')), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 64), ''), 'fact') slug, nullif(regexp_extract(content, {S.lit(V.SESSION_IN_HEADER)}, 1), '') trace, md5(left(trim(regexp_replace(content, '\s+', ' ', 'g')), 90)) headline,
 md5(trim(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')[1])) as first, nullif(regexp_extract(content, '([\w.\-]+(?:/[\w.\-]+)+\.\w+)', 1), '') path, left(regexp_replace(scope, '[^a-zA-Z0-9._\-]+', '_', 'g'), 120) safe, {_HASH.format('scope, id')} hash, coalesce(len({S.tokens('content')}), -1) tokens from {S.REC}""",
    "user_share": rf"""with r as (select id, content from {S.REC} where layer = 'L0' and trim(content) <> ''), b as (select id, string_split(regexp_replace(content, {S.lit(V.HEADER)}, ''), chr(10)) ls from r), l as (select id, unnest(ls) l, generate_subscripts(ls, 1) i from b),
k as (select *, nullif(lower(regexp_extract(l, '(?i)^(user|assistant)\s*:\s?', 1)), '') who, length(regexp_replace(l, '(?i)^(user|assistant)\s*:\s?', '')) m from l), c as (select *, last_value(who ignore nulls) over (partition by id order by i) w from k),
s as (select id, case when sum(m) > 0 then sum(case when coalesce(w, 'user') = 'user' then m else 0 end) / sum(m)::double else 0.5 end share from c group by 1)
select id, round(share, 6) share, share > 0.6 user_heavy, round(1 + 0.35 * greatest(0.0, share - 0.5) * 2, 6) factor from s""",
    "date_functions": f"select id, {S.date_key('metadata.date')} date_key, strftime({S.record_date('metadata.date')}, '%Y-%m-%d') record_date, strftime(ingested_at::timestamptz at time zone 'UTC', '%Y-%m-%d') as day, strftime(ingested_at::timestamptz at time zone 'UTC', '%Y-%m-%d') day_s from {S.REC}",
    "note_records": f"""with n as (select id, content, tags, metadata.mtimeMs m, floor(greatest(0, 1782000000000 - metadata.mtimeMs) / 60000.0 + 0.5) mins from {S.NOTE} where trim(content) <> ''), h as (select *, floor(mins / 60.0 + 0.5) hrs from n), d as (select *, floor(hrs / 24.0 + 0.5)::int dd from h)
select id, md5('note: ' || content) as content, case when len(list_intersect(coalesce(tags, []), [{', '.join(map(S.lit, V.OFFICE_TAGS))}])) > 0 then 0.9::double else 0.7 end ss, case when m is null or m <= 0 or mins < 15 then '' when mins < 60 then 'updated ~30m ago' when hrs < 4 then 'updated ~2h ago' when hrs < 12 then 'updated earlier today' when hrs < 24 then 'updated today' when hrs < 48 then 'updated yesterday' when dd <= 7 then 'updated ~' || dd || 'd ago' when dd <= 30 then 'updated ~weeks ago' else 'updated >1mo ago' end age from d""",
    "todo_items": f"with {_ITEMS} select doc_id, pos, num, subject, status from items where length(subject) > 0",
    "todo_facts": f"""with {_ITEMS}, f as (select distinct scope, status fact, subject from items where status in ('completed', 'blocked') and length(subject) >= 3)
select scope, {_HASH.format("scope, 'todo', fact, subject")} id, 'task ' || fact || ': ' || subject as content, case when fact = 'blocked' then 0.6::double else 0.4 end ss, case when fact = 'blocked' then 0.8::double else 0.5 end rs from f""",
    "todo_anchor": f"""with {_ITEMS}, k as (select *, row_number() over (partition by doc_id, status order by num, subject) n from items where length(subject) > 0)
select doc_id, coalesce(string_agg(subject, '; ' order by n) filter (where status = 'in_progress' and n <= 3), '') active, count(*) filter (where status = 'pending') pending, count(*) filter (where status = 'completed') completed, count(*) filter (where status = 'blocked') blocked from k group by 1""",
    "corrections": rf"""with s as (select doc_id, unnest(p) x, generate_subscripts(p, 1) j from (select doc_id, string_split_regex(text, '[。！？!?\n；;]+|\.\s+') p from documents where length(text) >= 8)),
t as (select doc_id, j, regexp_replace(trim(regexp_replace(x, '^\s+|\s+$', '', 'g')), '^[-*>\s]+', '') c from s), g as (select doc_id, c, min(j) j from t where length(c) between 8 and 300 and ({S.matches('c', V.CORRECTION_ZH)} or {S.matches('c', V.CORRECTION_EN)}) group by 1, 2)
select doc_id, i - 1 i, c correction from (select *, row_number() over (partition by doc_id order by j) i from g) where i <= 3""",
    "persona_seeds": rf"""with l as (select doc_id, pos, trim(line) b from {_lines('persona-seed')}), s as (select doc_id, pos, b, coalesce(nullif(lower(regexp_extract(b, '(?i)^\[(autobiographical|embodied)\]\s*', 1)), ''), 'autobiographical') facet, trim(regexp_replace(b, '(?i)^\[(autobiographical|embodied)\]\s*', '')) seed from l where b <> '' and b not like '#%')
select doc_id, pos, facet, seed from s where seed <> ''""",
    "facts": "with r as (select id, content from " + S.REC + " where content is not null), f as (" + " union all ".join(f"select id, {S.lit(k + ': ')} k, " + " || ' ' || ".join(f"trim(regexp_extract(content, {S.lit(p)}, {g}))" for g in range(1, n + 1)) + f" v from r where {S.matches('content', p)}" for k, p, n in V.FACT_RULES) + ") select id, k || v fact from f where length(v) between 3 and 199",
    "summary_sections": f"with ln as {_lines('compaction')}, {_SECT.replace('{k}', 'doc_id')} select doc_id, section, name, pos i, trim(line) line from sections",
    "summary_merge": f"""with pick as (select *, row_number() over (partition by scope order by created_at desc, doc_id desc) age from {_docs('compaction')}), ln as (select scope, age, unnest(string_split(replace(text, chr(13), ''), chr(10))) line, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) - 1 pos from pick where age <= 2), {_SECT.replace('{k}', 'scope, age')},
b as (select scope, name, pos i, trim(line) line, 2 - age old from sections), f as (select *, row_number() over (partition by scope, name, lower(trim(line)) order by old, i) fi, max(old) over (partition by scope, name) nw from b),
k as (select * from f where case when name in ('Goal', 'Notes') then old = 0 or fi = 1 when name in ('Working state', 'Evidence') then old = nw else old = 0 end),
p as (select *, row_number() over (partition by scope, name order by old, i) pl, count(*) over (partition by scope, name) n from k)
select scope, name, row_number() over (partition by scope, name order by old, i) place, line from p where case when name in ('Goal', 'Notes') then pl > n - 80 when name in ('Working state', 'Evidence') then true else pl <= 40 end""",
    "summary_valid": f"select doc_id, contains(text, '[Goal]') goal, contains(text, '[Working state]') as state, contains(text, '[Goal]') and contains(text, '[Working state]') and contains(text, '[Notes]') complete from {_docs('compaction')}",
    "embedding_chunks": f"""with r as (select id, content, least(greatest(ceil(length(content) / 1200.0), 1), 6)::int n from {S.REC} where trim(content) <> ''), c as (select id, n, unnest(range(0, n)) chunk, content from r)
select id, case when n = 1 then id else id || '#c' || chunk end "key", chunk, length(substr(content, chunk * 1200 + 1, 1200)) chars, md5(substr(content, chunk * 1200 + 1, 1200)) digest from c""",
    "cache_misses": f"""with r as (select id, content, least(greatest(ceil(length(content) / 1200.0), 1), 6)::int n from {S.REC} where trim(content) <> ''), c as (select id, n, unnest(range(0, n)) chunk from r), k as (select id, case when n = 1 then id else id || '#c' || chunk end k from c)
select id, count(*) missing from k where k not in (select key from vector_entry where len(vec) > 0 and key is not null) group by 1""",
    "current_vectors": r"with c as (select key, vec from (select *, row_number() over (partition by key order by seq desc) rn from vector_entry where key is not null) where rn = 1) select key, regexp_replace(key, '#c\d+$', '') id, round(sqrt(list_sum(list_transform(vec, lambda x: x::double * x::double))), 4) norm from c where len(vec) = 64 and len(list_filter(vec, lambda x: isnan(x))) = 0",
    "idempotent_append": f"""with r as (select id, scope, {_MONTH.format('ingested_at')} as month, ingested_at from memory_record where schema = 1 and id is not null)
select id, scope, month from (select *, row_number() over (partition by id order by ingested_at) n from r where month >= '2025-07') where n = 1 and id not in (select id from r where month < '2025-07')""",
    "metadata_json": f"select id, try_cast(metadata.extra as json) ->> 'sourceSession' source_session, coalesce((try_cast(metadata.extra as json) ->> 'promoted')::boolean, false) promoted from {S.REC} where metadata.extra is not null",
}
