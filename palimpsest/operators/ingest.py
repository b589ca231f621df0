"""From messages and tool results to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text

PACK_CHARS = 1200
#: Argument names that may hold a tool call's path, in order.
PATH_KEYS = ["path", "file_path", "filePath", "target_file", "filename"]


def stitch(messages: DataFrame, session: str = "session", pos: str = "pos") -> DataFrame:
    """Adjacent parts of one document as one message: `[part k/m]` behind equal text, k counting up until m. A marker at
    the very start of a message doesn't count. messages(session, pos, role, content)."""
    part = r"(?s)^(.+?)\[part (\d+)/(\d+)\]"
    key, k, m = F.trim(F.regexp_extract("content", part, 1)), F.regexp_extract("content", part, 2).try_cast("int"), F.regexp_extract("content", part, 3).try_cast("int")
    w = W.partitionBy(session).orderBy(pos)
    p = messages.withColumns({"_key": F.when(k.isNotNull(), key), "_k": k, "_m": m})
    goes_on = (F.lag("_key").over(w) == F.col("_key")) & (F.lag("_k").over(w) + 1 == F.col("_k")) & (F.lag("_k").over(w) < F.lag("_m").over(w))
    island = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    g = p.withColumn("_i", island).groupBy(session, "_i").agg(F.min(pos).alias(pos), F.min_by("role", pos).alias("role"), F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), "content"))).alias("c"))
    return g.select(session, pos, "role", F.array_join(F.transform("c", lambda x: x["content"]), "\n").alias("content"))


def pack(lines: Column, limit: int = PACK_CHARS) -> Column:
    """Lines joined to texts of at most `limit` characters, line breaks not counted; a longer line is a text by itself."""

    def step(acc, line):
        n = F.length(line)
        fits = (acc["n"] > 0) & (acc["len"] + n <= limit) & (n <= limit) & ~acc["full"]
        joined = F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.concat(F.element_at(acc["out"], -1), F.lit("\n"), line)))
        return F.when(fits, F.struct(joined.alias("out"), (acc["n"] + 1).alias("n"), (acc["len"] + n).alias("len"), F.lit(False).alias("full"))).otherwise(
            F.struct(F.concat(acc["out"], F.array(line)).alias("out"), F.lit(1).alias("n"), n.alias("len"), (n > limit).alias("full"))
        )

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"), F.lit(0).alias("len"), F.lit(False).alias("full"))
    return F.aggregate(lines, zero, step, lambda a: a["out"])


def ingest(messages: DataFrame, turns: str = "turn") -> DataFrame:
    """Evidence of each session's messages(session, pos, role, content, date, turn): packed texts with a header where the
    session has a date, ids by session and number."""
    g = messages.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))), lambda x: F.concat(x["role"], F.lit(": "), x["content"])).alias("lines"), F.min("date").alias("date"), F.max(turns).alias("turn"))
    each = g.select("session", "date", "turn", F.posexplode(pack(F.col("lines"))).alias("n", "body"))
    header = F.when(F.col("date") != "", F.concat(F.lit("["), "date", F.lit("] (session "), "session", F.lit(")\n"))).otherwise("")
    return each.select(text.record_id(F.col("session"), F.col("n").cast("string")).alias("id"), "session", "date", "turn", F.concat(F.coalesce(header, F.lit("")), "body").alias("content"), F.lit("L0").alias("layer"), F.lit("episodic").alias("kind"), F.lit(0.5).alias("storageStrength"), F.lit(0.5).alias("retrievalStrength"))


_TODO = r"^\s*([○◯◐◓◑✓✔✗✖⊘])\s*#(\d+)\s+(.{1,120}?)\s*$"
_BLOCKED = r"(?i)\s*[-–—]\s*blocked\b.*$"


def todo_items(lines: DataFrame) -> DataFrame:
    """lines(line, ...) that are to-do items, with num, subject and status; a blocked suffix decides before the mark."""
    mark, raw = F.regexp_extract("line", _TODO, 1), F.trim(F.regexp_extract("line", _TODO, 3))
    blocked = raw.rlike(_BLOCKED)
    status = F.when(blocked | mark.isin("✗", "✖", "⊘"), "blocked").when(mark.isin("○", "◯"), "pending").when(mark.isin("◐", "◓", "◑"), "in_progress").otherwise("completed")
    subject = F.when(blocked, F.trim(F.regexp_replace(raw, _BLOCKED, ""))).otherwise(raw)
    return lines.where(mark != "").withColumns({"num": F.regexp_extract("line", _TODO, 2).cast("int"), "subject": subject, "status": status}).where(F.length("subject") > 0)


def todo_facts(items: DataFrame, key: list[str]) -> DataFrame:
    """Evidence of completed and blocked items: items(key, subject, status), subjects of 3 to 120 characters; equal facts of
    a key are one row."""
    f = items.where(F.col("status").isin("completed", "blocked") & (F.length("subject") >= 3))
    rows = f.select(*key, F.col("status").alias("fact"), "subject").distinct()
    hot = F.col("fact") == "blocked"
    return rows.select(*key, text.record_id(*[F.col(k) for k in key], F.lit("todo"), F.col("fact"), F.col("subject")).alias("id"), F.concat(F.lit("task "), "fact", F.lit(": "), "subject").alias("content"), F.when(hot, 0.6).otherwise(0.4).alias("ss"), F.when(hot, 0.8).otherwise(0.5).alias("rs"))


def todo_anchor(items: DataFrame, key: list[str]) -> DataFrame:
    """A list's focus: first three subjects in progress, in order of their numbers, and counts."""
    active = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("status") == "in_progress", F.struct("num", "subject")))), 1, 3), lambda x: x["subject"])
    n = lambda s: F.count_if(F.col("status") == s)
    return items.groupBy(*key).agg(F.array_join(active, "; ").alias("active"), n("pending").alias("pending"), n("completed").alias("completed"), n("blocked").alias("blocked"))


def file_operations(calls: DataFrame) -> DataFrame:
    """Evidence of tool calls(session, turn, tool, args JSON) that change files: the first non-blank path argument."""
    path = F.coalesce(*[F.when(F.trim(F.get_json_object("args", f"$.{k}")) != "", F.get_json_object("args", f"$.{k}")) for k in PATH_KEYS])
    verb = F.when(F.col("tool") == "write", "wrote").otherwise("edited")
    rows = calls.where(F.lower("tool").isin("edit", "write", "notebookedit")).withColumn("path", F.substring(F.trim(path), 1, 240)).where(F.col("path").isNotNull())
    return rows.select("session", "turn", "path", F.concat(verb, F.lit(" "), "path").alias("content"), F.lit(0.4).alias("ss"), F.lit(0.5).alias("rs"))


def error_text(text_: Column, limit: int = 8000) -> Column:
    """Whole lines within `limit` characters; the first always stays."""
    zero = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc, line):
        n = F.length(acc["t"]) + F.when(acc["n"] > 0, 1).otherwise(0) + F.length(line)
        stop = acc["done"] | ((acc["n"] > 0) & (n > limit))
        return F.when(stop, F.struct(acc["t"].alias("t"), acc["n"].alias("n"), F.lit(True).alias("done"))).otherwise(F.struct(F.when(acc["n"] > 0, F.concat(acc["t"], F.lit("\n"), line)).otherwise(line).alias("t"), (acc["n"] + 1).alias("n"), F.lit(False).alias("done")))

    return F.aggregate(F.split(text_, "\n"), zero, step, lambda a: a["t"])


def seeds(lines: DataFrame) -> DataFrame:
    """lines(line, ...) of a persona seed: marker and text; without a marker autobiographical; comments and blanks skipped."""
    body = F.trim("line")
    mark = F.regexp_extract(body, r"(?i)^\[(autobiographical|embodied)\]\s*", 1)
    rest = F.trim(F.regexp_replace(body, r"(?i)^\[(autobiographical|embodied)\]\s*", ""))
    return lines.where((body != "") & ~body.startswith("#")).withColumns({"facet": F.when(mark != "", F.lower(mark)).otherwise("autobiographical"), "seed": rest}).where(F.col("seed") != "")


def sections(docs: DataFrame, key: list[str], content: str = "text") -> DataFrame:
    """(key, section, name, line_no, line): non-blank lines below `[Name]` lines, in order; what stands before the first is left out."""
    lines = docs.select(*key, F.posexplode(F.split(F.regexp_replace(content, "\r", ""), "\n")).alias("i", "line"))
    name = F.regexp_extract("line", r"^\[([^\]]+)\]\s*$", 1)
    w = W.partitionBy(*key).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumns({"head": name, "section": F.sum((name != "").cast("int")).over(w), "name": F.last(F.when(name != "", name), True).over(w)})
    return marked.where((F.col("section") > 0) & (F.col("head") == "") & (F.trim("line") != "")).select(*key, "section", "name", "i", "line")


#: Sections that accumulate, and the order in which known ones stand.
STABLE = ("Goal history", "Project notes")
CANONICAL = ("Goal history", "Working state", "Todo snapshot", "Project notes", "Key session evidence")
STABLE_CAP, UNKNOWN_CAP = 80, 40


def merged_sections(prev: DataFrame, fresh: DataFrame, key: list[str], stable_names: tuple = STABLE, known_names: tuple = CANONICAL) -> DataFrame:
    """A previous summary merged with a fresh one, section by section: stable ones accumulate distinct lines and keep the
    last 80; volatile ones are the fresh ones', else the previous; others of the previous stay, up to 40 lines.

    prev, fresh: (key, name, i, line). (key, name, place, line)."""
    both = prev.withColumn("old", F.lit(0)).unionByName(fresh.withColumn("old", F.lit(1)))
    stable, known = F.col("name").isin(*stable_names), F.col("name").isin(*known_names)
    first = F.row_number().over(W.partitionBy(*key, "name", F.lower(F.trim("line"))).orderBy("old", "i"))
    newest = F.max("old").over(W.partitionBy(*key, "name"))
    # Repeated lines of the previous summary stay as they are; only fresh ones are held against it and each other.
    kept = both.withColumns({"_first": first, "_newest": newest}).where(F.when(stable, (F.col("old") == 0) | (F.col("_first") == 1)).when(known, F.col("old") == F.col("_newest")).otherwise(F.col("old") == 0))
    w = W.partitionBy(*key, "name")
    kept = kept.withColumns({"place": F.row_number().over(w.orderBy("old", "i")), "_n": F.count(F.lit(1)).over(w)})
    kept = kept.where(F.when(stable, F.col("place") > F.col("_n") - STABLE_CAP).when(known, F.lit(True)).otherwise(F.col("place") <= UNKNOWN_CAP))
    return kept.select(*key, "name", F.row_number().over(w.orderBy("old", "i")).alias("place"), "line")


def record_chunks(records: DataFrame, size: int = 1200, most: int = 6) -> DataFrame:
    """(id, key, chunk, text): what is embedded of a record; one chunk has the record's id as key, several have suffixes."""
    c = records.select("id", text.chunks(F.col("content"), size, most).alias("c"))
    each = c.select("id", F.size("c").alias("n"), F.posexplode("c").alias("chunk", "text"))
    return each.select("id", F.when(F.col("n") == 1, F.col("id")).otherwise(F.concat("id", F.lit("#c"), "chunk")).alias("key"), "chunk", "text")


def cache_misses(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, missing): records with a chunk that has no vector; they are encoded whole. chunks(id, key), vectors(key)."""
    return chunks.join(vectors.select("key").distinct(), "key", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("missing"))


def header_date(content: Column) -> Column:
    return F.regexp_extract(content, r"^\s*\[(\d{4}-\d{2}-\d{2})\]", 1)


