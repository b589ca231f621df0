"""Parts of the SQL that queries are held against (DuckDB dialect)."""

from palimpsest.functions import vocabulary as V

REC = "(select * exclude (rn) from (select *, row_number() over (partition by id order by ingested_at) rn from memory_record where schema = 1 and id is not null) where rn = 1)"
NOTE = "(select * exclude (rn) from (select *, row_number() over (partition by id order by ingested_at) rn from note_record where schema = 1 and id is not null) where rn = 1)"
SIG = "(select * exclude (rn) from (select *, row_number() over (partition by query_id, id order by seq desc) rn from score_signal where query_id is not null and id is not null) where rn = 1)"
ACC = "(select id, list(turn order by seq) turns from (select distinct id, seq, turn from access_log where id is not null and turn is not null) group by id)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def stem(w: str) -> str:
    return rf"case when regexp_matches({w}, '^[a-z].{{4}}') then case when length({w}) >= 6 and regexp_matches({w}, 'ie[sd]$') then regexp_replace({w}, 'ie[sd]$', 'y') else regexp_replace({w}, '^(.{{3,}}?)(?:ings|ing|ed|es|s)$', '\1') end else {w} end"


def tokens(x: str) -> str:
    return rf"list_distinct(list_concat(list_transform(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9_\-]{{3,}}')), lambda w: {stem('w')}), regexp_extract_all({x}, '[\x{{4e00}}-\x{{9fff}}]')))"


def overlap(a: str, b: str) -> str:
    return f"(case when least(len({a}), len({b})) > 0 then len(list_intersect({a}, {b})) / least(len({a}), len({b}))::double else 0.0 end)"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def question_class(q: str) -> str:
    m = lambda p: matches(q, p)
    task = f"({m(V.CODE_ARTIFACT)} or {m(V.CODE_TOKEN)} or (({m(V.TASK_IMPERATIVE)} or {m(V.TASK_HOWTO)}) and ({m(V.TASK_OBJECT)} or {m(V.TASK_FAILURE)})) or ({m(V.TASK_FAILURE)} and {m(V.TASK_OBJECT)}))"
    return f"case when {task} then 'task' when {m(V.ASSISTANT_CONTENT)} then 'assistant-content' when {m(V.AGGREGATION)} then 'aggregation' when {m(V.TEMPORAL)} then 'temporal' when {m(V.PERSONAL_FACT)} then 'personal-fact' else 'default' end"


def rs_at(rs: str, turn: str, now: str) -> str:
    return f"greatest(0.0, {rs} - greatest(0, {now} - {turn}) * 0.012)"


def bla(log: str, now: str) -> str:
    return f"(0.05 * ln(1 + case when len({log}) > 32 then len({log}) / 0.5 * power(greatest(1, {now} - list_min({log})), -0.5) when len({log}) > 0 then list_sum(list_transform({log}, lambda t: power(greatest(1, {now} - t), -0.5))) else 0 end))"


def record_date(x: str) -> str:
    return rf"try_cast(nullif(regexp_extract({x}, '(\d{{4}}-\d{{1,2}}-\d{{1,2}})', 1), '') as date)"


def question_date(x: str) -> str:
    return rf"try_cast(nullif(replace(regexp_extract({x}, '^(\d{{4}}/\d{{1,2}}/\d{{1,2}})', 1), '/', '-'), '') as date)"


def date_key(x: str) -> str:
    return rf"nullif(replace(regexp_extract({x}, '^(\d{{4}}[-/]\d{{2}}[-/]\d{{2}})', 1), '/', '-'), '')"


def trace(session: str, content: str) -> str:
    return f"coalesce(nullif(trim({session}), ''), nullif(regexp_extract({content}, {lit(V.SESSION_IN_HEADER)}, 1), ''))"


# One row for each current candidate of each query that names an active, non-blank record.
POOL = f"""
r as {REC}, sig as {SIG}, acc as {ACC},
pool0 as (
  select q.query_id, q.query, q.options, q.question_date, q.top_k, q.semanticWeight w, r.id, r.content, r.turn, r.accessLog own, coalesce(r.storageStrength, 0) ss0, coalesce(r.retrievalStrength, 0) rs0,
    r.metadata.date date, r.metadata.sessionId session, r.metadata.taskRef taskref, r.metadata.path path, r.metadata.paths paths, r.sourceRefs, r.supersededBy, coalesce(r.archived, false) archived, r.layer, r.kind, r.scope, case when isnan(s.semanticScore) then null else s.semanticScore end sem, s.rerankScore rerank, a.turns extra
  from recall_query q join sig s on s.query_id = q.query_id join r on r.id = s.id left join acc a on a.id = r.id
  where r.supersededBy is null and trim(r.content) <> ''),
stat as (select query_id, max(turn) + 1 as now, count(*) n, count(distinct coalesce(session, '?')) sessions, sum(length(content))::bigint chars, avg(regexp_matches(content, '(?i)\\nassistant:|^assistant:')::int) voice, max(date) newest, bool_or(length(date) >= 8) dated from pool0 group by 1),
pool as (
  select p.*, s.now, s.n, s.sessions, s.chars, s.voice, coalesce(s.newest, '') newest, coalesce(s.dated, false) dated,
    case when len(extra) > 0 then list_slice(list_concat(own, extra), -32, -1) else own end log,
    case when len(extra) > 0 then least(1.0, ss0 + 0.05 * len(extra)) else ss0 end ss,
    case when len(extra) > 0 then greatest(rs0, greatest(0.0, 1 - greatest(0, s.now - greatest(turn, list_max(extra))) * 0.012)) else rs0 end rs
  from pool0 p join stat s on s.query_id = p.query_id)
"""


def ranked(weights: tuple[float, float, float], query: str = "query", source: str = "pool") -> str:
    """`tok` and `ranked`: the pool with its score, lexical overlap and place."""
    return f"""
tok as (select *, {tokens(query)} qt, {tokens('content')} rt from {source}),
lex as (select *, {overlap('qt', 'rt')} * case when len(list_intersect(qt, rt)) = 1 then 0.5 else 1 end lexical from tok),
scored as (select * exclude (qt, rt), (case when w > 0 and sem is not null then greatest(lexical, sem) + w * least(lexical, sem) else lexical end) * {weights[0]} + {rs_at('rs', 'turn', 'now')} * {weights[1]} + ln(1 + ss) * {weights[2]} + {bla('log', 'now')} score from lex)
"""
