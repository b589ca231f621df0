"""Queries on links between records: full hierarchies (p3) and orphan references (p7), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import hierarchy, orphans
from palimpsest.runtime import cut, table, utc_month
from palimpsest.sources.records import notes, records, ref_key

SEP = "\x1f"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, key, asked, parent) of every record and note: its own name and key, and those of what it names. All are prefixed by
    kind, so a parent is of its child's kind."""
    r = records(spark, sf_dir, ["id", "supersededBy", "ingested_at"]).select(F.lit("record").alias("kind"), "id", F.col("supersededBy").alias("ref"))
    n = notes(spark, sf_dir, ["id", "supersedes", "ingested_at"]).select(F.lit("note").alias("kind"), "id", F.col("supersedes").alias("ref"))
    of = lambda c, name: F.concat("kind", F.lit(SEP), c).alias(name)
    return r.unionByName(n).select(of(F.col("id"), "name"), of(ref_key(F.col("id")), "key"), of(F.col("ref"), "asked"), of(ref_key(F.col("ref")), "parent"))


def _links(nodes: DataFrame) -> DataFrame:
    """(node, parent) by stored ids; of several ids of one key a link goes to the one spelled as the link is, else to the smallest."""
    named = nodes.where(F.col("key").isNotNull()).groupBy(F.col("key").alias("parent")).agg(F.min("name").alias("first"), F.count(F.lit(1)).alias("n"))
    # Only linked nodes take part; ids travel once, with the link.
    found = nodes.where(F.col("parent").isNotNull()).select(F.col("name").alias("node"), "asked", "parent").join(named, "parent")
    exact = nodes.select(F.col("name").alias("asked"), F.col("name").alias("exact"))
    several = found.where(F.col("n") > 1).join(exact, "asked", "left").select("node", F.coalesce("exact", "first").alias("parent"))
    return found.where(F.col("n") == 1).select("node", F.col("first").alias("parent")).unionByName(several)


def _resolved(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """Nodes are named by their stored id, behind the kind."""
    return hierarchy.resolve(_links(_nodes(spark, sf_dir)), **kw)


def _bare(c: str):
    return F.element_at(F.split(F.col(c), SEP, 2), 2)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, paths=False).select(_bare("node").alias("id"), _bare("root").alias("root_id"), "depth")


def p3_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and number of descendants of every linked node, loops marked."""
    solved = cut(_resolved(spark, sf_dir))
    size = hierarchy.descendants(solved).groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"))
    names = F.transform("path", lambda x: F.element_at(F.split(x, SEP, 2), 2))
    return solved.join(size, "node", "left").select(
        F.element_at(F.split("node", SEP, 2), 1).alias("kind"),
        _bare("node").alias("id"),
        _bare("root").alias("root_id"),
        "depth",
        F.array_join(names, "/").alias("path"),
        F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"),
        F.col("looped").alias("runs_into_loop"),
    )


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (ancestor, descendant) pair with its distance."""
    return hierarchy.descendants(_resolved(spark, sf_dir)).select(_bare("ancestor").alias("ancestor_id"), _bare("descendant").alias("descendant_id"), "distance")


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, field, ref, key, period): each distinct reference as stored, of every record."""
    r = records(spark, sf_dir, ["id", "sourceRefs", "supersededBy", "ingested_at"]).withColumn("period", utc_month(F.col("ingested_at")))
    listed = r.select("id", F.lit("sourceRefs").alias("field"), F.explode(F.array_distinct("sourceRefs")).alias("ref"), "period")
    single = r.select("id", F.lit("supersededBy").alias("field"), F.col("supersededBy").alias("ref"), "period")
    return listed.unionByName(single).withColumn("key", ref_key(F.col("ref"))).where(F.col("key").isNotNull())


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    purged = table(spark, sf_dir, "purged_id").select(ref_key(F.col("id")).alias("key"), utc_month(F.col("purged_at")).alias("gone")).where(F.col("key").isNotNull())
    seen = lambda df: df.select(ref_key(F.col("id")).alias("key"), utc_month(F.col("ingested_at")).alias("since"))
    r, n = seen(records(spark, sf_dir, ["id", "ingested_at"])), seen(notes(spark, sf_dir, ["id", "ingested_at"]))
    source, superseding = F.lit("sourceRefs").alias("field"), F.lit("supersededBy").alias("field")
    no, yes = F.lit(False).alias("ever"), F.lit(True).alias("ever")
    live = r.unionByName(n)
    # Deletions are tagged parent rows of their own kind: they set `gone` of their group without making it present.
    tagged = [live.select(source, "key", "since", F.lit(None).cast("string").alias("gone"), no), r.select(superseding, "key", "since", F.lit(None).cast("string").alias("gone"), yes)]
    both = tagged[0].unionByName(tagged[1])
    gone = purged.groupBy("key").agg(F.min("gone").alias("gone"))
    return both.drop("gone").join(gone, "key", "left").select("field", "key", "since", "gone", "ever")


def _orphans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    refs = _references(spark, sf_dir)
    return refs, orphans.orphan_keys(refs, _parents(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, bad = _orphans(spark, sf_dir)
    on = bad.select(F.col("field").alias("f"), F.col("key").alias("k"), F.col("period").alias("p"))
    return refs.join(on, (F.col("field") == F.col("f")) & (F.col("key") == F.col("k")) & F.col("period").eqNullSafe(F.col("p")), "left_semi").select("id", "field", "ref", "period")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, sf_dir)[1])


QUERIES = {"p3_found": p3_found, "p3_hierarchy": p3_hierarchy, "p3_descendants": p3_descendants, "p7_found": p7_found, "p7_report": p7_report}

_KEY = r"nullif(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '#c\d+$', ''), '')"
_REC = "(select * exclude (rn) from (select *, row_number() over (partition by id order by ingested_at) rn from {0} where schema = 1 and id is not null) where rn = 1)"
_MONTH = "strftime({0}::timestamptz at time zone 'UTC', '%Y-%m')"

_LINKS = f"""
with recursive nodes as (
  select 'record' kind, id, {_KEY.format('id')} k, {_KEY.format('supersededBy')} p from {_REC.format('memory_record')}
  union all select 'note', id, {_KEY.format('id')}, {_KEY.format('supersedes')} from {_REC.format('note_record')}),
links as (select c.kind, c.id node, q.id parent from nodes c join nodes q on c.kind = q.kind and c.p = q.k),
walk as (
  select kind, node, parent cur, 1 d, [node] seen from links
  union all select w.kind, w.node, l.parent, w.d + 1, list_append(w.seen, w.cur) from walk w join links l on l.kind = w.kind and l.node = w.cur where not list_contains(w.seen, w.cur)),
ends as (select kind, node, max_by(cur, d) last, max(d) d, max_by(seen, d) seen from walk group by 1, 2),
solved as (
  select kind, node, list_contains(seen, last) looped,
    case when list_contains(seen, last) then list_min(seen[list_position(seen, last):]) else last end root,
    case when list_contains(seen, last) then -1 else d end depth,
    case when not list_contains(seen, last) then list_reverse(list_append(seen, last)) end path
  from ends
  union all select distinct kind, last, false, last, 0, [last] from ends where not list_contains(seen, last))
"""

_REFS = f"""
with r as {_REC.format('memory_record')}, n as {_REC.format('note_record')},
refs as (
  select distinct id, 'sourceRefs' field, ref, {_MONTH.format('ingested_at')} period from (select id, unnest(sourceRefs) ref, ingested_at from r)
  union all select id, 'supersededBy', supersededBy, {_MONTH.format('ingested_at')} from r),
keyed as (select *, {_KEY.format('ref')} k from refs where {_KEY.format('ref')} is not null),
tgt as (select 'sourceRefs' field, {_KEY.format('id')} k, min({_MONTH.format('ingested_at')}) since from (select id, ingested_at from r union all select id, ingested_at from n) group by 1, 2
  union all select 'supersededBy', {_KEY.format('id')}, min({_MONTH.format('ingested_at')}) from r group by 1, 2),
gone as (select {_KEY.format('id')} k, min({_MONTH.format('purged_at')}) gone from purged_id group by 1),
bad as (
  select c.*, case when t.k is null then 'missing' when g.gone is not null and (c.field = 'supersededBy' or g.gone <= c.period) then 'deleted' when c.field = 'sourceRefs' and t.since > c.period then 'late' end reason
  from keyed c left join tgt t on t.field = c.field and t.k = c.k left join gone g on g.k = c.k)
"""

SQL = {
    "p3_found": _LINKS + "select node id, root root_id, depth::int as depth from solved",
    "p3_hierarchy": _LINKS
    + """, pairs as (select kind, unnest(path[:-2]) anc from solved where depth > 0), sizes as (select kind, anc, count(*) n from pairs group by 1, 2)
select s.kind, node id, root root_id, depth::int as depth, array_to_string(path, '/') path, coalesce(n, 0) n_descendants, looped runs_into_loop from solved s left join sizes z on z.kind = s.kind and z.anc = s.node""",
    "p3_descendants": _LINKS + "select path[i] ancestor_id, node descendant_id, (depth + 1 - i)::int as distance from (select node, path, depth, unnest(range(1, depth + 1)) i from solved where depth > 0)",
    "p7_found": _REFS + "select id, field, ref, period from bad where reason is not null",
    "p7_report": _REFS
    + "select field, period, count(*) n_refs, count(distinct k || reason) n_keys, count(*) filter (where reason = 'missing') n_missing, count(*) filter (where reason = 'deleted') n_deleted, count(*) filter (where reason = 'late') n_late from bad where reason is not null group by 1, 2",
}
