"""Queries of explicit recall and of the rows derived from a ranking, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import score, temporal, text
from palimpsest.functions import vocabulary as V
from palimpsest.operators import rank, recall
from palimpsest.plans import search as P
from palimpsest.plans import sqlparts as S
from palimpsest.runtime import table
from palimpsest.sources.records import records, ref_key


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.search_ranked(P.pool(spark, sf_dir), P.Options())


def lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five records of the whole store that share most with each query."""
    active = records(spark, sf_dir, ["id", "content", "supersededBy"]).where(F.col("supersededBy").isNull() & (F.trim("content") != ""))
    about = table(spark, sf_dir, "memory_record").count()  # from the files' footers
    return recall.lexical_top(table(spark, sf_dir, "recall_query"), active, 5, about).select("query_id", "id", "shared", "pos", F.round("overlap", 6).alias("overlap"))


def bm25_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.bm25(P.pool(spark, sf_dir)).select("query_id", "id", "found", "place", F.round("bm25", 6).alias("bm25"))


def hybrid_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by words, then by vectors, within eight items and 3 000 characters."""
    p = P.pool(spark, sf_dir)
    hits = recall.hybrid(recall.bm25(p), p.select("query_id", "id", "sem"))
    lines = hits.join(p.select("query_id", "id", "content"), ["query_id", "id"])
    return recall.char_prefix(lines, F.length("content"), 3000, True).select("query_id", "id", "channel", "pos", F.length("content").alias("chars"))


def memory_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranked(spark, sf_dir).where(F.col("pos") <= 30)
    return recall.leads(table(spark, sf_dir, "recall_query").select("query_id", "query"), r).select("query_id", "term", "n", "lead", "ids")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranked(spark, sf_dir).where(F.col("pos") <= 40).withColumn("date_key", temporal.date_key(F.col("date")))
    return recall.timeline(r)


def counting_aid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.counting_aid(_ranked(spark, sf_dir))


def disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.disclosures(_ranked(spark, sf_dir))


def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.contrasts(_ranked(spark, sf_dir))


def record_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec): the representative vector of a record: its own, else that of its first chunk."""
    v = table(spark, sf_dir, "vector_entry").where(F.col("key").isNotNull()).groupBy("key").agg(F.max_by(F.struct("vec"), "seq").alias("e")).select("key", "e.vec").where((F.size("vec") > 0) & ~F.exists("vec", F.isnan))
    own = v.select(ref_key(F.col("key")).alias("id"), "vec", F.when(F.col("key").rlike(r"#c\d+$"), F.regexp_extract("key", r"#c(\d+)$", 1).cast("int")).otherwise(-1).alias("k"))
    return own.where(F.col("k") <= 0).groupBy("id").agg(F.min_by("vec", "k").alias("vec"))


def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.suppressed(_ranked(spark, sf_dir).join(record_vectors(spark, sf_dir), "id", "left").select("query_id", "id", "pos", "layer", "trace", "vec"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.clusters(P.pool(spark, sf_dir).join(record_vectors(spark, sf_dir), "id", "left"))


def chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each candidate to its query's best candidate, by the best of the record's chunks of the same length."""
    v = table(spark, sf_dir, "vector_entry").where(F.col("key").isNotNull()).groupBy("key").agg(F.max_by(F.struct("vec"), "seq").alias("e")).select(ref_key(F.col("key")).alias("id"), "e.vec").where((F.size("vec") > 0) & ~F.exists("vec", F.isnan))
    p = P.pool(spark, sf_dir).select("query_id", "id", "sem")
    best = p.where(F.col("sem").isNotNull()).groupBy("query_id").agg(F.min_by("id", F.struct(-F.col("sem"), "id")).alias("lead_id"))
    lead = best.join(record_vectors(spark, sf_dir).select(F.col("id").alias("lead_id"), F.col("vec").alias("lead")), "lead_id")
    pairs = p.join(v, "id").join(lead, "query_id").where(F.size("vec") == F.size("lead"))
    return pairs.groupBy("query_id", "id").agg(F.round(F.max(score.cosine(F.col("vec"), F.col("lead"))), 5).alias("similarity"))


QUERIES = {"lexical_rank": lexical_rank, "bm25_recall": bm25_recall, "hybrid_recall": hybrid_recall, "memory_leads": memory_leads, "timeline": timeline, "counting_aid": counting_aid, "disclosures": disclosures, "contrast_pairs": contrasts, "repeat_suppression": suppressed, "leader_clusters": clusters, "chunk_scores": chunk_scores}

_BASE = P._BASE
_TERMS0 = r"list_filter(string_split_regex(lower(query), '[^a-z0-9_\-\x{4e00}-\x{9fff}]+'), lambda t: length(t) >= 2 or regexp_matches(t, '[\x{4e00}-\x{9fff}]'))"
_GOOD = f"list_filter({_TERMS0}, lambda t: t not in ({', '.join(map(S.lit, V.QUERY_STOPS))}))"
_BM25 = rf"""with {S.POOL},
t0 as (select query_id, id, case when len({_GOOD}) > 0 then {_GOOD} else {_TERMS0} end terms, lower(content) low, len(string_split_regex(lower(content), '\s+')) dl from pool),
av as (select query_id, avg(dl) av, count(*) n from t0 group by 1),
h0 as (select query_id, id, dl, low, len(terms) q, unnest(list_distinct(terms)) term from t0),
h as (select *, ((length(low) - length(replace(low, term, ''))) / length(term))::int tf from h0 where contains(low, term)),
df as (select query_id, term, count(*) df from h group by 1, 2),
s as (select h.query_id, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) bm25, count(*) found, any_value(q) q from h join df using (query_id, term) join av using (query_id) group by 1, 2),
k as (select *, max(bm25) over (partition by query_id) best from s where found >= case when q >= 3 then 2 else 1 end and bm25 > 0),
bm as (select query_id, id, found, row_number() over (partition by query_id order by round(bm25, 9) desc, id) place, round(bm25, 6) bm25 from k where round(bm25, 9) >= round(best * 0.1, 9))"""
_VEC = r"cur as (select key, vec from (select *, row_number() over (partition by key order by seq desc) rn from vector_entry where key is not null) where rn = 1 and len(vec) > 0 and len(list_filter(vec, lambda x: isnan(x))) = 0), ck as (select regexp_replace(lower(trim(key)), '#c\d+$', '') id, vec, coalesce(try_cast(nullif(regexp_extract(key, '#c(\d+)$', 1), '') as int), -1) k from cur), rep as (select id, min_by(vec, k) lead from ck where k <= 0 group by 1)"
SQL = {
    "lexical_rank": f"""with r as (select id, {S.tokens('content')} t from {S.REC} where supersededBy is null and trim(content) <> ''), q as (select query_id, {S.tokens('query')} t from recall_query),
qe as (select query_id, len(t) nq, unnest(t) tok from q), re as (select id, len(t) nr, unnest(t) tok from r),
h as (select query_id, id, count(*) shared, any_value(nq) nq, any_value(nr) nr from qe join re using (tok) group by 1, 2),
o as (select *, shared / least(nq, nr)::double * case when shared = 1 then 0.5 else 1 end ov from h)
select query_id, id, shared, pos, round(ov, 6) overlap from (select *, row_number() over (partition by query_id order by round(ov, 9) desc, shared desc, id) pos from o) where pos <= 5""",
    "bm25_recall": _BM25 + " select query_id, id, found, place, bm25 from bm",
    "hybrid_recall": _BM25
    + """, sm as (select query_id, id, row_number() over (partition by query_id order by round(sem, 9) desc, id) place from pool p where sem >= 0.35 and not exists (select 1 from bm where bm.query_id = p.query_id and bm.id = p.id)),
u as (select query_id, id, 'bm25' channel, place from bm union all select query_id, id, 'semantic', place from sm where place <= 12),
o as (select *, row_number() over (partition by query_id order by channel, place) pos from u),
c as (select o.*, length(content) chars, sum(length(content)) over (partition by o.query_id order by pos) cum from o join pool using (query_id, id) where pos <= 8)
select query_id, id, channel, pos, chars from c where cum <= 3000 or pos = 1""",
    "memory_leads": f"""{_BASE}, top as (select * from f2 where pos <= 30), tm as (select query_id, unnest(list_filter({S.tokens('query')}, lambda t: length(t) >= 4 and t not in ({', '.join(S.lit(x) for x in V.LEAD_STOPS)}))) term from recall_query),
m as (select t.query_id, term, id, pos, row_number() over (partition by t.query_id, term order by pos) i from tm t join top using (query_id) where contains(lower(content), term)),
n as (select query_id, term, count(*) n, string_agg(id, ', ' order by pos) filter (where i <= 3) ids from m group by 1, 2)
select query_id, term, n, lead, ids from (select *, row_number() over (partition by query_id order by n desc, term) as lead from n) where lead <= 6""",
    "timeline": rf"""{_BASE}, t as (select query_id, pos, content, turn, {S.date_key('date')} dk from f2 where pos <= 40),
g as (select query_id, case when dk is not null then 'date' else 'turn' end axis, coalesce(dk, lpad(turn::varchar, 12, '0')) at_, min_by(left(trim(regexp_replace(content, '\s+', ' ', 'g')), 90), pos) headline from t group by 1, 2, 3),
w as (select *, count(*) over (partition by query_id, axis) n, row_number() over (partition by query_id, axis order by at_) up, count(*) over (partition by query_id) al from g)
select query_id, axis, at_ "at", headline from w where al >= 2 and (n <= 15 or up <= 8 or up > n - 7)""",
    "counting_aid": rf"""{_BASE}, f as (select query_id, pos, nullif(trim(regexp_extract(query, '(?i)how many\s+(?:\w+\s+)*?(\w[\w\s]*?)(?:\s+(?:do|did|have|has|are|were|was|is|have I|did I|am I))', 1)), '') entity,
  left(trim(regexp_replace(string_split_regex(regexp_replace(content, '^\[\d{{4}}-\d{{2}}-\d{{2}}\]\s*\(session [^)]+\)\n', ''), '[.!?]\s')[1], '(?i)^(user|assistant):\s*', '')), 120) fact from f2 where pos <= 15 and regexp_matches(query, '(?i)\bhow many\b')),
d as (select *, row_number() over (partition by query_id, left(lower(fact), 40) order by pos) i from f where entity is not null and length(fact) >= 10 and not regexp_matches(fact, '(?i)as an ai|i don''t have|i cannot|i''m not able')),
n as (select *, row_number() over (partition by query_id order by pos) number, count(*) over (partition by query_id) c from d where i = 1)
select query_id, entity, number, fact from n where c >= 2""",
    "disclosures": rf"""{_BASE}, u as (select query_id, pos, unnest(string_split(regexp_replace(content, {S.lit(V.HEADER)}, ''), chr(10))) l, generate_subscripts(string_split(regexp_replace(content, {S.lit(V.HEADER)}, ''), chr(10)), 1) j from f2 where pos <= 60),
v as (select query_id, pos, j, string_split(regexp_replace(regexp_replace(regexp_replace(l, '(?i)^user\s*:\s*', ''), '\s+', ' ', 'g'), '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)) p from u where regexp_matches(l, '(?i)^user\s*:')),
x as (select query_id, pos, j, trim(unnest(p)) s, generate_subscripts(p, 1) i from v),
n as (select *, row_number() over (partition by query_id order by pos, j, i) number from x where length(s) > 3 and not regexp_matches(s, '\?\s*$') and {S.matches('s', V.DISCLOSURE_MARKER)})
select query_id, number, left(s, 240) sentence from n where number <= 12""",
    "chunk_scores": f"""with {S.POOL}, {_VEC}, best as (select query_id, min_by(id, (-sem, id)) lead_id from pool where sem is not null group by 1), ld as (select query_id, lead from best join rep on rep.id = lead_id)
select query_id, p.id, round(max(case when list_dot_product(vec::double[], vec::double[]) > 0 and list_dot_product(lead::double[], lead::double[]) > 0 and not isnan(list_dot_product(vec::double[], vec::double[])) then list_dot_product(vec::double[], lead::double[]) / sqrt(list_dot_product(vec::double[], vec::double[])) / sqrt(list_dot_product(lead::double[], lead::double[])) else 0.0 end), 5) similarity
from pool p join ck on ck.id = p.id join ld using (query_id) where len(vec) = len(lead) group by 1, 2""",
}
