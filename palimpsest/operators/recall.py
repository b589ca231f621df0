"""Explicit recall: lexical search over all records, BM25 over a pool, hybrid with vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.functions import vocabulary as V
from palimpsest.operators import lexical
from palimpsest.runtime import cut

#: Records that one task holds against all queries.
BLOCK = 65536


def lexical_top(queries: DataFrame, records: DataFrame, k: int, about: int = 0) -> DataFrame:
    """(query_id, id, shared, overlap, pos): the k records that share most with each query.

    queries(query_id, query), records(id, content). Records are dealt out to blocks, one for each BLOCK of the `about` records
    there are; all queries meet each block in one task, which sends the k best of the block for each query. So neither the
    pairs that share a token nor the lists of tokens by record are ever rows. Records that share nothing aren't listed. Ties
    are ordered by the id.
    """
    blocks = max(queries.sparkSession.sparkContext.defaultParallelism, -(-about // BLOCK))
    tokens = lambda c: F.coalesce(text.tokens(F.col(c)), F.array().cast("array<string>")).alias("t")
    q = queries.select("query_id", tokens("query")).groupBy("query_id").agg(F.flatten(F.collect_list("t")).alias("t"), F.first(F.size("t")).alias("n"))
    q = q.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "query_id", F.lit(None).cast(records.schema["id"].dataType).alias("id"), "t", "n")
    r = records.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "id", tokens("content"), F.lit(None).cast("int").alias("n"))

    kind = lambda d, c: d.schema[c].dataType.simpleString()
    hits = r.unionByName(q).groupBy("block").applyInArrow(lexical.in_block(k), f"query_id {kind(queries, 'query_id')}, id {kind(records, 'id')}, shared bigint, least bigint")
    over = F.col("shared") / F.col("least") * F.when(F.col("shared") == 1, V.SINGLE_TERM).otherwise(1.0)
    pos = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("overlap", 9).desc(), F.col("shared").desc(), "id"))
    return hits.withColumn("overlap", over).withColumn("pos", pos).where(F.col("pos") <= k).drop("least")


def bm25(rows: DataFrame, query: str = "query", content: str = "content", group: str = "query_id", key: str = "id") -> DataFrame:
    """rows that recall returns, with bm25 and place: terms are found inside words; with three terms and more two must be
    found; scores below a tenth of the best are noise. Statistics are those of the group's rows."""
    base = rows.select(group, key, F.col(query).alias("_query"), F.col(content).alias("_content"))
    query, low = "_query", F.lower(F.coalesce("_content", F.lit("")))
    base = base.withColumns({"_terms": text.query_terms(F.col(query)), "_low": low, "_dl": F.size(F.split(low, r"\s+"))})
    avg = base.groupBy(group).agg(F.avg("_dl").alias("_avg"), F.count(F.lit(1)).alias("_n"))
    # Terms are counted inside the row, so that no text is repeated for each of them.
    count = lambda t: ((F.length("_low") - F.length(F.replace(F.col("_low"), t, F.lit("")))) / F.length(t)).cast("int")
    counted = F.filter(F.transform(F.array_distinct("_terms"), lambda t: F.struct(t.alias("term"), count(t).alias("tf"))), lambda x: x["tf"] > 0)
    hits = base.select(group, key, "_dl", F.size("_terms").alias("_q"), F.inline(counted))
    df = hits.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"))
    x = hits.join(df, [group, "term"]).join(avg, group)
    idf = F.log((F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (V.BM25_K + 1) / (F.col("tf") + V.BM25_K * (1 - V.BM25_B + V.BM25_B * F.col("_dl") / F.col("_avg")))
    s = x.groupBy(group, key).agg(F.sum(part).alias("bm25"), F.count(F.lit(1)).alias("found"), F.first("_q").alias("_q"))
    s = s.where((F.col("found") >= F.when(F.col("_q") >= 3, 2).otherwise(1)) & (F.col("bm25") > 0))
    best = s.groupBy(group).agg(F.max("bm25").alias("_best"))
    kept = s.join(best, group).where(F.round("bm25", 9) >= F.round(F.col("_best") * V.NOISE_FLOOR, 9))
    return kept.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.round("bm25", 9).desc(), key))).select(group, key, "bm25", "found", "place")


def hybrid(lexical: DataFrame, semantic: DataFrame, items: int = 8, most: int = 12, group: str = "query_id", key: str = "id") -> DataFrame:
    """BM25 hits in their order, then semantic hits that aren't among them, in theirs; the first `items`.

    lexical(group, key, place), semantic(group, key, sem): the `most` best of at least the cosine floor count.
    """
    s = semantic.where(F.col("sem") >= V.COSINE_FLOOR).join(lexical.select(group, key), [group, key], "left_anti")
    s = s.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.round("sem", 9).desc(), key))).where(F.col("place") <= most)
    both = lexical.select(group, key, F.lit("bm25").alias("channel"), "place").unionByName(s.select(group, key, F.lit("semantic").alias("channel"), "place"))
    both = both.withColumn("pos", F.row_number().over(W.partitionBy(group).orderBy("channel", "place")))
    return both.where(F.col("pos") <= items)


def char_prefix(rows: DataFrame, size, budget: int, first_free: bool, group: str = "query_id", order: str = "pos", head: int = 0) -> DataFrame:
    """The first rows whose sizes fit a budget that a header of `head` characters has a share in."""
    total = F.sum(size).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)) + head
    n = F.row_number().over(W.partitionBy(group).orderBy(order))
    marked = rows.withColumns({"chars_so_far": total, "_n": n})
    return marked.where((F.col("chars_so_far") <= budget) | (F.lit(first_free) & (F.col("_n") == 1))).drop("_n")


def leads(queries: DataFrame, rows: DataFrame, terms: int = 6, ids: int = 3) -> DataFrame:
    """(query_id, term, n, ids): words of a question that occur in its pool, the most frequent first; ids in rank order.

    rows(query_id, id, content, pos).
    """
    good = F.filter(text.tokens(F.col("query")), lambda t: ~t.isin(V.LEAD_STOPS) & (F.length(t) >= 4))
    asked = queries.select("query_id", F.explode(good).alias("term"))
    met = cut(asked.join(rows.select("query_id", "id", "pos", F.lower("content").alias("low")), "query_id").where(F.contains("low", "term")).drop("low"))  # read twice
    n = met.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
    first = met.withColumn("i", F.row_number().over(W.partitionBy("query_id", "term").orderBy("pos"))).where(F.col("i") <= ids).groupBy("query_id", "term").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]), ", ").alias("ids"))
    best = n.withColumn("lead", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("n").desc(), "term"))).where(F.col("lead") <= terms)
    return best.join(first, ["query_id", "term"])


def timeline(rows: DataFrame, head: int = 90, cap: int = 15, first: int = 8, last: int = 7) -> DataFrame:
    """(query_id, axis, at, headline): the best-placed record of each date, and of each turn of the undated; of more than
    `cap` groups on an axis the earliest and latest. Queries with one group have none. rows(query_id, pos, content, turn, date_key)."""
    axis = F.when(F.col("date_key").isNotNull(), "date").otherwise("turn")
    at = F.coalesce("date_key", F.lpad(F.col("turn").cast("string"), 12, "0"))
    g = rows.groupBy("query_id", axis.alias("axis"), at.alias("at")).agg(F.min_by(text.headline(F.col("content"), head), "pos").alias("headline"))
    w = W.partitionBy("query_id", "axis")
    g = g.withColumns({"_n": F.count(F.lit(1)).over(w), "_up": F.row_number().over(w.orderBy("at")), "_all": F.count(F.lit(1)).over(W.partitionBy("query_id"))})
    return g.where((F.col("_all") >= 2) & ((F.col("_n") <= cap) | (F.col("_up") <= first) | (F.col("_up") > F.col("_n") - last))).select("query_id", "axis", "at", "headline")


def counting_aid(rows: DataFrame, most: int = 15) -> DataFrame:
    """(query_id, entity, number, fact): distinct facts of the first records, for questions that count something."""
    f = rows.where((F.col("pos") <= most)).withColumns({"entity": text.counted_entity(F.col("query")), "fact": text.key_fact(F.col("content"))})
    f = f.where(F.col("query").rlike(r"(?i)\bhow many\b") & F.col("entity").isNotNull() & (F.length("fact") >= 10) & ~F.col("fact").rlike(V.GENERIC_REPLY))
    once = f.withColumn("i", F.row_number().over(W.partitionBy("query_id", F.substring(F.lower("fact"), 1, 40)).orderBy("pos"))).where(F.col("i") == 1)
    w = W.partitionBy("query_id")
    return once.withColumns({"number": F.row_number().over(w.orderBy("pos")), "_n": F.count(F.lit(1)).over(w)}).where(F.col("_n") >= 2).select("query_id", "entity", "number", "fact")


def disclosures(rows: DataFrame, most: int = 12, records: int = 60, chars: int = 240) -> DataFrame:
    """(query_id, number, sentence): what users volunteered, in rank order: sentences of their lines with a marker and no question."""
    body = F.regexp_replace("content", V.HEADER, "")
    lines = F.transform(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"(?i)^user\s*:")), lambda x: F.regexp_replace(x, r"(?i)^user\s*:\s*", ""))
    each = rows.where(F.col("pos") <= records).select("query_id", "pos", F.posexplode(F.flatten(F.transform(lines, text.sentences))).alias("i", "s"))
    good = each.where(~F.col("s").rlike(r"\?\s*$") & F.col("s").rlike(V.DISCLOSURE_MARKER))
    return good.withColumn("number", F.row_number().over(W.partitionBy("query_id").orderBy("pos", "i"))).where(F.col("number") <= most).select("query_id", "number", F.substring("s", 1, chars).alias("sentence"))


def contrasts(rows: DataFrame, first: int = 20, least: float = 0.5, most: int = 4) -> DataFrame:
    """(query_id, id_a, id_b, only_a, only_b): pairs among a query's first records that are easily confused, each record in
    one pair at most, taken greedily in rank order. The fold runs over at most `first` records of a query."""
    import pandas as pd

    toks = F.filter(text.tokens(F.col("content")), lambda t: F.length(t) >= 4)
    top = rows.where(F.col("pos") <= first).select("query_id", "pos", "id", toks.alias("toks"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        ids, sets, out, used = list(pdf["id"]), [list(t) for t in pdf["toks"]], [], set()
        for i in range(len(ids)):
            for j in range(i + 1, len(ids)):
                if len(out) >= most or i in used:
                    break
                a, b = set(sets[i]), set(sets[j])
                if j in used or not a or not b or len(a & b) / min(len(a), len(b)) < least or a <= b or b <= a:
                    continue
                used |= {i, j}
                out.append((pdf["query_id"].iloc[0], ids[i], ids[j], " ".join([t for t in sets[i] if t not in b][:5]), " ".join([t for t in sets[j] if t not in a][:5])))
        return pd.DataFrame(out, columns=["query_id", "id_a", "id_b", "only_a", "only_b"])

    return top.groupBy("query_id").applyInPandas(pick, "query_id string, id_a string, id_b string, only_a string, only_b string")


def suppressed(rows: DataFrame, similarity: float = 0.9) -> DataFrame:
    """(query_id, id, pos) of the rows that stay: an L0 row that repeats an earlier kept L0 row of its session goes, all others
    are kept: rows(query_id, pos, id, layer, trace, vec)."""
    import numpy as np
    import pandas as pd

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        kept: list[int] = []
        taken: dict[tuple, list] = {}  # kept L0 vectors by session and length
        for i, (layer, t, v) in enumerate(zip(pdf["layer"], pdf["trace"], pdf["vec"], strict=True)):
            if layer == "L0" and t is not None and v is not None:
                v = np.asarray(v, float)
                others, norm = taken.setdefault((t, len(v)), []), np.linalg.norm(v)
                if norm > 0:
                    if any(float(np.dot(u, v)) / (n * norm) >= similarity for u, n in others):
                        continue
                    others.append((v, norm))
            kept.append(i)
        return pdf.iloc[kept][["query_id", "id", "pos"]]

    return rows.groupBy("query_id").applyInPandas(keep, "query_id string, id string, pos int")


def clusters(rows: DataFrame, cosine: float = 0.55, shared: int = 3, least: int = 3, most: int = 8) -> DataFrame:
    """Greedy leader clusters of a query's pool in turn order: a record joins the first cluster whose seed it resembles, by
    cosine if both have vectors, else by shared words. (query_id, cluster, n, sessions, first_turn, last_turn, latest).
    rows(query_id, id, turn, session, content, vec): pools are bounded by what a query's candidates are."""
    import numpy as np
    import pandas as pd

    stops = set(V.CLUSTER_STOPS)
    toks = rows.select("query_id", "id", "turn", "session", "content", "vec", text.tokens(F.col("content")).alias("toks"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "id"], kind="stable")
        seeds: list[tuple] = []
        members: list[list[int]] = []
        for i, (v, t) in enumerate(zip(pdf["vec"], pdf["toks"], strict=True)):
            v, t = None if v is None else np.asarray(v, float), set(t) - stops
            for c, (sv, st) in enumerate(seeds):
                if v is not None and sv is not None and len(v) == len(sv):
                    norm = np.linalg.norm(v) * np.linalg.norm(sv)
                    close = norm > 0 and float(v @ sv) / norm >= cosine
                else:
                    close = len(t & st) >= shared
                if close:
                    members[c].append(i)
                    break
            else:
                seeds.append((v, t))
                members.append([i])
        big = sorted((m for m in members if len(m) >= least), key=lambda m: (-len(m), int(pdf["turn"].iloc[m[0]]), pdf["id"].iloc[m[0]]))[:most]
        out = [(pdf["query_id"].iloc[0], c + 1, len(m), pdf.iloc[m]["session"].nunique(), int(pdf.iloc[m]["turn"].min()), int(pdf.iloc[m]["turn"].max()), pdf["id"].iloc[m[-1]]) for c, m in enumerate(big)]
        return pd.DataFrame(out, columns=["query_id", "cluster", "n", "sessions", "first_turn", "last_turn", "latest"])

    return toks.groupBy("query_id").applyInPandas(fold, "query_id string, cluster int, n int, sessions int, first_turn bigint, last_turn bigint, latest string")
