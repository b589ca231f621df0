"""The search pipeline and its parts, over the pools of `recall_query`, with their SQL.

A query's pool are the records its current `score_signal` rows name; `semanticScore` is the semantic cue.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import score, temporal, text
from palimpsest.functions import vocabulary as V
from palimpsest.operators import rank
from palimpsest.plans import sqlparts as S
from palimpsest.runtime import table
from palimpsest.sources.records import records


@dataclass(frozen=True)
class Options:
    """Settings of a search. policy 1 is plain; 2 adds classes' budgets, content-distinct rows and self-reference; 4 to 6
    cap rows per trace at 1 to 3; 13 decays from an `as of` date; 14 and 15 from any anchor; 18 adds update markers and a
    larger budget."""

    policy: int = 2
    semantic_weight: float | None = None
    floor: float = V.RECALL_FLOOR
    budget: int | None = None
    diversity: float = 0.0

    def __post_init__(self):
        if not 1 <= self.policy <= 18 or (self.semantic_weight is not None and not 0 <= self.semantic_weight <= 1) or self.floor < 0 or (self.budget is not None and self.budget <= 0):
            raise ValueError(f"no such settings: {self}")

    @property
    def per_trace(self) -> int | None:
        return {4: 1, 5: 2, 6: 3}.get(self.policy)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "score_signal").where(F.col("query_id").isNotNull() & F.col("id").isNotNull())
    body = F.struct("semanticScore", "score", "bm25Score", "rerankScore")
    return s.groupBy("query_id", "id").agg(F.max_by(body, "seq").alias("b")).select("query_id", "id", "b.*")


def pool(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None, sig: DataFrame | None = None) -> DataFrame:
    """One row for each candidate of each query, with the statistics of the query's pool. asked and sig stand in for the
    tables recall_query and score_signal where given: sig(query_id, id, sem, rerank) names the candidates."""
    m = F.col("metadata")
    keep = {c: F.col(c) for c in ("id", "content", "turn", "accessLog", "scope", "layer", "kind", "sourceRefs", "supersededBy")} | {
        "storageStrength": F.coalesce("storageStrength", F.lit(0.0)), "retrievalStrength": F.coalesce("retrievalStrength", F.lit(0.0)), "archived": F.coalesce("archived", F.lit(False)),
        "date": m["date"], "session": m["sessionId"], "taskref": m["taskRef"], "path": m["path"], "paths": m["paths"],
    }
    active = records(spark, sf_dir, keep).where(F.col("supersededBy").isNull() & (F.trim("content") != ""))
    # What depends on the question alone is worked out once per question, below the join.
    ask = F.col("query")
    q = (table(spark, sf_dir, "recall_query") if asked is None else asked).select(
        "query_id", "query", "options", "question_date", "top_k", F.col("semanticWeight").alias("w"), text.question_class(ask).alias("class"), temporal.expressions(ask).alias("exprs"), temporal.question_date(F.col("question_date")).alias("asked_on"),
        temporal.query_anchor(ask).alias("anchor"), (ask.rlike(V.CURRENT_STATE) & ~ask.rlike(V.PAST_QUESTION)).alias("current"),
    )
    sig = sig if sig is not None else signals(spark, sf_dir).select("query_id", "id", F.when(~F.isnan("semanticScore"), F.col("semanticScore")).alias("sem"), F.col("rerankScore").alias("rerank"))
    # Only the candidates' accesses are folded, and beside the record, so that its text is sent once more, to its query.
    log = table(spark, sf_dir, "access_log").join(sig.select("id").distinct(), "id", "left_semi")
    rows = sig.join(active, "id").join(rank.fold_access(log), "id", "left").join(q, "query_id")
    stats = rows.groupBy("query_id").agg(
        (F.max("turn") + 1).alias("now"), F.count(F.lit(1)).alias("n"), F.countDistinct(F.coalesce("session", F.lit("?"))).alias("sessions"), F.sum(F.length("content")).alias("chars"),
        F.avg(F.col("content").rlike(r"(?i)\nassistant:|^assistant:").cast("int")).alias("voice"), F.coalesce(F.max("date"), F.lit("")).alias("newest"), F.coalesce(F.bool_or(F.length("date") >= 8), F.lit(False)).alias("dated"),
    )
    return rank.accessed(rows.join(stats, "query_id"), F.col("now"))


def resolved_budget(o: Options):
    """Characters a query's evidence may have."""
    k = F.col("class")
    small, reference = F.col("chars") <= 20_000, (F.col("sessions") <= 2) & (F.col("chars") > 20_000) & (F.col("voice") < 0.2) & (k != "task")
    by_class = F.element_at(F.create_map(*[x for c, b in V.BUDGETS.items() for x in (F.lit(c), F.lit(b))]), k)
    if o.budget:
        return F.lit(o.budget)
    out = F.when(reference, F.least(F.col("chars") + 4000, F.lit(80_000)))
    if o.policy == 1:
        return out.otherwise(8000)
    out = out.when((k == "default") & small, F.col("chars") + 4000)
    if o.policy == 18:
        out = out.when(~small & k.isin("default", "personal-fact"), F.least(F.col("chars") + 4000, F.lit(60_000)))
    return out.otherwise(by_class)


def search_ranked(rows: DataFrame, o: Options) -> DataFrame:
    """The pool scored, re-scored, placed and cut at the recall floor."""
    if o.semantic_weight is not None:
        rows = rows.withColumn("w", F.lit(o.semantic_weight))
    r = rank.scored(rows, V.WEIGHTS_SEARCH).withColumns({"day": temporal.record_date(F.col("date")), "trace": text.trace_id(F.col("session"), F.col("content"))})
    s, current = F.col("score"), F.col("current")
    if o.policy in (13, 14, 15, 18):
        anchor = F.col("anchor")
        if o.policy != 13:
            anchor = F.coalesce(anchor, F.when(current, temporal.record_date(F.col("newest"))))
        s = s * score.as_of(F.datediff(anchor, F.col("day")))
    s = s * temporal.boost(F.col("exprs"), F.col("day"), F.col("asked_on"))
    if o.policy > 1:
        s = s * score.self_reference(F.col("class"), text.user_share(F.col("content")))
    if o.policy == 18:
        s = s * F.when(~F.col("dated") & current & F.col("content").rlike(V.UPDATE_MARKER), V.UPDATE_BOOST).otherwise(1.0)
    # Placed before it is cut: what falls below the floor is the tail, and a filter below the window would score twice.
    r = rank.placed(r.withColumn("score", s)).where(F.col("score") >= o.floor)
    if o.diversity:
        r = rank.diverse(r, o.diversity).withColumn("pos", F.col("diverse_pos"))
    return rank.per_trace(r, o.per_trace) if o.per_trace else r


def search(rows: DataFrame, o: Options = Options()) -> DataFrame:
    """(query_id, pos, id, content, score): the evidence of each query."""
    r = search_ranked(rows, o)
    if o.policy > 1:
        r = rank.first_of_content(r)
    out = rank.budget_prefix(r, resolved_budget(o), F.least(F.col("top_k"), F.lit(200)))
    return out.select("query_id", F.col("place").alias("pos"), "id", "class", F.length("content").alias("chars"), F.round(F.least(F.lit(0.98), F.col("score")), 6).alias("score"))


def _q(options: Options):
    return lambda spark, sf_dir: search(pool(spark, sf_dir), options)


def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its place and fidelity level, for injection."""
    r = rank.fidelity(rank.placed(rank.scored(pool(spark, sf_dir), V.WEIGHTS_CONTEXT)))
    return r.select("query_id", "id", "pos", "level", F.round("lexical", 6).alias("lexical"), F.round("score", 6).alias("score"))


def injection_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that injection lets in: active, not archived, above the threshold or pinned, and on topic."""
    r = rank.placed(rank.scored(pool(spark, sf_dir).where(~F.col("archived")), V.WEIGHTS_CONTEXT))
    topical = (F.col("lexical") > 0) | (F.col("sem") >= V.COSINE_FLOOR)
    return r.where(((F.round("score", 9) >= V.ACTIVATION) | (F.col("storageStrength") >= V.PINNED)) & topical).select("query_id", "id", "pos", F.round("score", 6).alias("score"))


def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = search_ranked(pool(spark, sf_dir), Options())
    return rank.diverse(r, 0.2).select("query_id", "id", "pos", "diverse_pos")


def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = search_ranked(pool(spark, sf_dir), Options())
    return rank.reranked(r, "rerank").select("query_id", "id", "pos", "reranked")


def option_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings by the question and by each of its options, merged by the best score of a record."""
    p = pool(spark, sf_dir)
    asks = F.filter(F.concat(F.array("query"), F.coalesce("options", F.array().cast("array<string>"))), lambda x: x.isNotNull())
    each = rank.scored(p.withColumn("ask", F.explode(F.array_distinct(asks))), V.WEIGHTS_CONTEXT, "ask")
    best = each.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_asks"))
    return rank.fidelity(rank.placed(best)).select("query_id", "id", "n_asks", "pos", "level", F.round("score", 6).alias("score"))


def temporal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose date satisfies a time expression of the question; each query gets expressions of every kind to match."""
    p = pool(spark, sf_dir)
    day, anchor = temporal.record_date(F.col("date")), temporal.question_date(F.col("question_date"))
    asked = F.concat_ws(" ", "query", F.lit("yesterday, 3 weeks ago, 2 months ago, last year, in march, on may 5, 2025-06-01"))
    return p.select("query_id", "id", temporal.boost(temporal.expressions(asked), day, anchor).alias("factor")).where(F.col("factor") > 1)


def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, budget and gates of every query."""
    q = F.col("query")
    kinds = text.question_class(q)
    budget = F.element_at(F.create_map(*[x for c, b in V.BUDGETS.items() for x in (F.lit(c), F.lit(b))]), kinds)
    return table(spark, sf_dir, "recall_query").select(
        "query_id", kinds.alias("class"), budget.alias("budget"), q.rlike(V.TEMPORAL_PROMPT).alias("timeline"), (q.rlike(V.CURRENT_STATE) & ~q.rlike(V.PAST_QUESTION)).alias("current_state"), q.rlike(V.UPDATE_MARKER).alias("update_marker"),
        q.rlike(V.ADVICE_NARROW).alias("advice"), q.rlike(V.ADVICE_WIDE).alias("advice_wide"), text.counted_entity(q).alias("entity"), F.date_format(temporal.query_anchor(q), "yyyy-MM-dd").alias("anchor"),
    )


def pool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir).withColumn("trace", text.trace_id(F.col("session"), F.col("content")))
    reference = (F.col("sessions") <= 2) & (F.col("chars") > 20_000) & (F.col("voice") < 0.2) & (F.col("class") != "task")
    return p.groupBy("query_id").agg(F.first("now").alias("now"), F.count(F.lit(1)).alias("n"), F.countDistinct("trace").alias("traces"), F.count_if(F.col("trace").isNull()).alias("untraced"), F.first("sessions").alias("sessions"), F.first("chars").alias("chars"), F.first("newest").alias("newest"), F.first("dated").alias("dated"), F.count_if(F.col("sem").isNotNull()).alias("with_vector"), (F.count("sem") / F.count(F.lit(1)) >= 0.9).alias("covered"), F.first(reference).alias("reference_doc"), F.first(resolved_budget(Options())).alias("budget"))


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs compared, query by query: order of ids, and characters within two percent."""
    p = pool(spark, sf_dir)
    run = lambda o, n: search(p, o).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias(f"ids_{n}"), F.sum("chars").alias(f"chars_{n}"))
    both = run(Options(policy=1), "a").join(run(Options(policy=5), "b"), "query_id", "full")
    near = F.abs(F.col("chars_a") - F.col("chars_b")) <= 0.02 * F.greatest("chars_a", "chars_b")
    return both.select("query_id", F.coalesce(F.col("ids_a") == F.col("ids_b"), F.lit(False)).alias("same_order"), F.coalesce(near, F.lit(False)).alias("same_size"), F.coalesce(F.size("ids_a"), F.lit(0)).alias("n_a"), F.coalesce(F.size("ids_b"), F.lit(0)).alias("n_b"))


QUERIES = {"search": _q(Options())} | {f"search_policy_{n}": _q(Options(policy=n)) for n in (1, 5, 13, 14, 18)}
QUERIES |= {"search_diverse": _q(Options(diversity=0.15)), "search_tuned": _q(Options(semantic_weight=0.45, floor=0.2, budget=3000))}
QUERIES |= {"hybrid_rank": hybrid_rank, "injection_gate": injection_gate, "diversity_rerank": diversity, "outside_rerank": rerank, "option_rank": option_rank, "temporal_match": temporal_match, "classify_questions": classify, "pool_stats": pool_stats, "drift": drift}

_SHARE = rf"""
lines as (select query_id, id, unnest(string_split(regexp_replace(content, {S.lit(V.HEADER)}, ''), chr(10))) l, generate_subscripts(string_split(regexp_replace(content, {S.lit(V.HEADER)}, ''), chr(10)), 1) i from pool),
roles as (select *, nullif(lower(regexp_extract(l, '(?i)^(user|assistant)\s*:\s?', 1)), '') who, length(regexp_replace(l, '(?i)^(user|assistant)\s*:\s?', '')) m from lines),
carried as (select *, last_value(who ignore nulls) over (partition by query_id, id order by i) r from roles),
share as (select query_id, id, case when sum(m) > 0 then sum(case when coalesce(r, 'user') = 'user' then m else 0 end) / sum(m)::double else 0.5 end share from carried group by 1, 2)
"""


def _month_case(x: str) -> str:
    return "case lower(" + x + ") " + " ".join(f"when '{k}' then {v}" for k, v in V.MONTHS.items()) + " end"


def _date(y: str, m: str, d: str) -> str:
    return f"try_cast(({y}) || '-' || lpad(({m})::varchar, 2, '0') || '-' || lpad({d}, 2, '0') as date)"


def _anchor_sql(q: str) -> str:
    out = []
    for p in (r"(?i)\bas of\s+([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s*(\d{4})", r"(?i)\bon\s+([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s*(\d{4})"):
        g = lambda i, p=p: f"regexp_extract({q}, {S.lit(p)}, {i})"
        out.append(_date(g(3), _month_case(g(1)), g(2)))
    zh = r"截至\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
    c = _date(*[f"regexp_extract({q}, '{zh}', {i})" for i in (1, 2, 3)])
    return f"coalesce({out[0]}, {c}, {out[1]}, {S.record_date(q)})"


def _expr_sql(q: str, day: str, anchor: str) -> str:
    """Whether a date satisfies one of the time expressions of q."""
    far, out = f"({anchor} - {day})", []
    for p, a, b, grouped in temporal.RELATIVE:
        n = f"try_cast(nullif(regexp_extract({q}, {S.lit(p)}, 1), '') as int)"
        out.append(f"coalesce({far} between greatest(0, {n} * {a} - {b}) and {n} * {a} + {b}, false)" if grouped else f"({S.matches(q, p)} and coalesce({far} between {a} and {b}, false))")
    for p, (y, m, d) in ((temporal.MONTH_RE, (3, 1, 2)), (temporal.ISO_RE, (1, 2, 3)), (temporal.US_RE, (3, 1, 2))):
        g = lambda i, p=p: f"nullif(regexp_extract(x, {S.lit(p)}, {i}), '')"
        month = _month_case(g(m)) if p == temporal.MONTH_RE else f"{g(m)}::int"
        out.append(f"len(list_filter(regexp_extract_all({q}, {S.lit(p)}), lambda x: coalesce({month} = month({day}) and ({g(d)} is null or {g(d)}::int = 0 or {g(d)}::int = day({day})) and ({g(y)} is null or {g(y)}::int = year({day})), false))) > 0")
    return "(" + " or ".join(out) + ")"


def _budget_sql(o: Options) -> str:
    if o.budget:
        return str(o.budget)
    reference = "when sessions <= 2 and chars > 20000 and voice < 0.2 and class <> 'task' then least(chars + 4000, 80000)"
    if o.policy == 1:
        return f"case {reference} else 8000 end"
    lift = "when chars > 20000 and class in ('default', 'personal-fact') then least(chars + 4000, 60000)" if o.policy == 18 else ""
    return f"case {reference} when class = 'default' and chars <= 20000 then chars + 4000 {lift} else case class " + " ".join(f"when '{c}' then {b}" for c, b in V.BUDGETS.items()) + " end end"


def _ranked_sql(o: Options, pool: str = "pool") -> str:
    w = f", p2 as (select * replace ({o.semantic_weight} as w) from pool)" if o.semantic_weight is not None else ""
    source = "p2" if w else pool
    factors = [f"case when {_expr_sql('query', 'day', 'qday')} and day is not null and qday is not null then {V.TEMPORAL_BOOST} else 1.0 end"]
    current = f"({S.matches('query', V.CURRENT_STATE)} and not {S.matches('query', V.PAST_QUESTION)})"
    if o.policy in (13, 14, 15, 18):
        anchor = _anchor_sql("query")
        if o.policy != 13:
            anchor = f"coalesce({anchor}, case when {current} then {S.record_date('newest')} end)"
        far = f"({anchor} - day)"
        factors.insert(0, f"case when {far} < 0 then 0.6 when {far} >= 0 then 1 + 0.25 * exp(-{far} / 14.0) else 1.0 end")
    if o.policy > 1:
        factors.append(f"case when class in ('personal-fact', 'aggregation', 'temporal') then 1 + {V.SELF_REFERENCE} * greatest(0.0, share - 0.5) * 2 else 1.0 end")
    if o.policy == 18:
        factors.append(f"case when not dated and {current} and {S.matches('content', V.UPDATE_MARKER)} then {V.UPDATE_BOOST} else 1.0 end")
    return f"""{w}, {S.ranked(V.WEIGHTS_SEARCH, source=source)}, {_SHARE},
f0 as (select s.*, {S.question_class('query')} class, {S.record_date('date')} as day, {S.question_date('question_date')} qday, {S.trace('session', 'content')} trace, share from scored s join share using (query_id, id)),
f1 as (select * replace (score * {' * '.join(factors)} as score) from f0),
f2 as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) pos from f1 where score >= {o.floor})"""


def _search_sql(o: Options) -> str:
    steps, last = "", "f2"
    if o.diversity:
        steps += f""", d0 as (select *, score * case when row_number() over (partition by query_id, trace order by pos) = 1 then {1 + o.diversity} else 1.0 end adj from {last}),
d1 as (select * replace (row_number() over (partition by query_id order by round(adj, 9) desc, pos) as pos) from d0)"""
        last = "d1"
    if o.per_trace:
        steps += f", t1 as (select * from (select *, row_number() over (partition by query_id, trace order by pos) tn from {last}) where trace is null or tn <= {o.per_trace})"
        last = "t1"
    if o.policy > 1:
        steps += f", c1 as (select * from (select *, row_number() over (partition by query_id, content order by pos) cn from {last}) where cn = 1)"
        last = "c1"
    return f"""with {S.POOL}{_ranked_sql(o)}{steps},
b as (select *, {_budget_sql(o)} budget, row_number() over (partition by query_id order by pos) place, sum(length(content)) over (partition by query_id order by pos rows unbounded preceding) cum from {last})
select query_id, place::int as pos, id, class, length(content) chars, round(least(0.98, score), 6) score from b where place <= least(top_k, 200) and (cum <= budget or place = 1)"""


_CONTEXT = f"with {S.POOL}, {S.ranked(V.WEIGHTS_CONTEXT)}, placed as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) pos from scored)"
_LEVEL = "case when pos <= greatest(1, floor(n * 0.3 + 1e-9)) then 'full' when pos <= greatest(1, floor(n * 0.3 + 1e-9)) + greatest(0, floor(n * 0.7 + 1e-9) - greatest(1, floor(n * 0.3 + 1e-9))) then 'summary' else 'anchor' end"
_BASE = f"with {S.POOL}{_ranked_sql(Options())}"

SQL = {"search": _search_sql(Options()), "search_diverse": _search_sql(Options(diversity=0.15)), "search_tuned": _search_sql(Options(semantic_weight=0.45, floor=0.2, budget=3000))}
SQL |= {f"search_policy_{n}": _search_sql(Options(policy=n)) for n in (1, 5, 13, 14, 18)}
SQL |= {
    "hybrid_rank": f"{_CONTEXT} select query_id, id, pos, {_LEVEL} as level, round(lexical, 6) lexical, round(score, 6) score from placed",
    "injection_gate": f"with {S.POOL}, open as (select * from pool where not archived), {S.ranked(V.WEIGHTS_CONTEXT, source='open')} select query_id, id, pos, round(score, 6) score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) pos from scored) where (round(score, 9) >= 0.28 or ss0 >= 0.9) and (lexical > 0 or sem >= 0.35)",
    "diversity_rerank": f"{_BASE}, d0 as (select *, score * case when row_number() over (partition by query_id, trace order by pos) = 1 then 1.2 else 1.0 end adj from f2) select query_id, id, pos, row_number() over (partition by query_id order by round(adj, 9) desc, pos) diverse_pos from d0",
    "outside_rerank": f"{_BASE} select query_id, id, pos, row_number() over (partition by query_id order by (pos > 40)::int, case when pos <= 40 then coalesce(case when isnan(rerank) then null else rerank end, -1) end desc nulls last, pos) reranked from f2",
    "option_rank": f"with {S.POOL}, asks as (select p.*, unnest(list_distinct(list_filter(list_concat([query], coalesce(options, [])), lambda x: x is not null))) ask from pool p), {S.ranked(V.WEIGHTS_CONTEXT, 'ask', 'asks')}, best as (select query_id, id, max(score) score, count(*) n_asks, any_value(n) n from scored group by 1, 2) select query_id, id, n_asks, pos, {_LEVEL} as level, round(score, 6) score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) pos from best)",
    "temporal_match": f"with {S.POOL}, d as (select query_id, id, query || ' yesterday, 3 weeks ago, 2 months ago, last year, in march, on may 5, 2025-06-01' q, {S.record_date('date')} as day, {S.question_date('question_date')} a from pool) select query_id, id, 1.3::double factor from d where day is not null and a is not null and {_expr_sql('q', 'day', 'a')}",
    "classify_questions": f"""select query_id, class, case class {' '.join(f"when '{c}' then {b}" for c, b in V.BUDGETS.items())} end budget, {S.matches('query', V.TEMPORAL_PROMPT)} timeline, ({S.matches('query', V.CURRENT_STATE)} and not {S.matches('query', V.PAST_QUESTION)}) current_state, {S.matches('query', V.UPDATE_MARKER)} update_marker,
  {S.matches('query', V.ADVICE_NARROW)} advice, {S.matches('query', V.ADVICE_WIDE)} advice_wide, nullif(trim(regexp_extract(query, '(?i)how many\\s+(?:\\w+\\s+)*?(\\w[\\w\\s]*?)(?:\\s+(?:do|did|have|has|are|were|was|is|have I|did I|am I))', 1)), '') entity, strftime({_anchor_sql('query')}, '%Y-%m-%d') anchor from (select *, {S.question_class('query')} class from recall_query)""",
    "pool_stats": f"""with {S.POOL}, c as (select *, {S.question_class('query')} class, {S.trace('session', 'content')} trace from pool)
select query_id, any_value(now) as now, count(*) n, count(distinct trace) traces, count(*) filter (where trace is null) untraced, any_value(sessions) sessions, any_value(chars) chars, any_value(newest) newest, any_value(dated) dated, count(sem) with_vector, count(sem) / count(*)::double >= 0.9 covered, any_value(sessions <= 2 and chars > 20000 and voice < 0.2 and class <> 'task') reference_doc, any_value({_budget_sql(Options())}) budget from c group by 1""",
}
_RUN = "(select query_id, list(id order by pos) ids, sum(chars) chars from ({0}) group by 1)"
SQL["drift"] = f"""select query_id, coalesce(a.ids = b.ids, false) same_order, coalesce(abs(a.chars - b.chars) <= 0.02 * greatest(a.chars, b.chars), false) same_size, coalesce(len(a.ids), 0)::int n_a, coalesce(len(b.ids), 0)::int n_b
from {_RUN.format(SQL['search_policy_1'])} a full join {_RUN.format(SQL['search_policy_5'])} b using (query_id)"""
