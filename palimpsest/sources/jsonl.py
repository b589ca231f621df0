"""Line-delimited JSON stores: tolerant readers and idempotent writers; notes from folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "schema int, id string, layer string, kind string, trust string, content string, turn bigint, accessLog array<bigint>, storageStrength double, retrievalStrength double, tags array<string>, sourceRefs array<string>, supersededBy string, archived boolean, category string, "
    "metadata struct<sessionId:string,date:string,taskRef:string,path:string,paths:array<string>,topicKey:string,ledger:boolean,aggregate:boolean,origin:string,verified:boolean,enriched:boolean,promotionCandidate:boolean,focusKey:string,supersedes:string,consolidatedIds:array<string>>"
)
ACCESS = "id string, turn bigint"
VECTOR = "id string, vec array<float>"
TODO = "schema int, items array<struct<num:int,subject:string,status:string>>"


def read_lines(spark: SparkSession, path: str, schema: str, version: int | None = 1, files: str = "*.jsonl") -> DataFrame:
    """Rows of JSON lines with their file; blank and corrupt lines and other schema versions are skipped; no files, no rows."""
    reader = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", files)
    try:
        rows = reader.json(path)
    except Exception as e:  # a store that was never written
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema).withColumn("file", F.lit(None).cast("string"))
    rows = rows.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    good = F.col("_corrupt").isNull() & (F.col("schema") == version if version is not None and schema.startswith("schema int") else F.lit(True))
    return rows.where(good).drop("_corrupt")


def read_records(spark: SparkSession, root: str, layer: str | None = None) -> DataFrame:
    """Evidence and derived rows below a root, with the scope their file is named for; one layer if asked for."""
    rows = read_lines(spark, root, RECORD).where(F.col("file").rlike(r"\.L[012]\.jsonl$"))
    rows = rows.withColumn("scope", F.regexp_replace("file", r"\.L[012]\.jsonl$", ""))
    return rows.where(F.col("layer") == layer) if layer else rows


def read_derived(spark: SparkSession, root: str, layer: str) -> DataFrame:
    if layer not in ("L1", "L2"):
        raise ValueError("derived rows are of layer L1 or L2")
    return read_records(spark, root, layer)


def read_written(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """Rows that write_records has written, layers being the names of their folders."""
    rows = read_lines(spark, path, f"{RECORD}, scope string", files="*.json")
    return rows.where(F.col("layer") == layer) if layer else rows


def read_todo_snapshot(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Items of a snapshot, of several if each is a line of its own; other schema versions are skipped."""
    doc = spark.read.schema(TODO).option("multiLine", whole_files).json(path)
    return doc.where(F.col("schema") == 1).select(F.explode("items").alias("i")).select("i.*")


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(id, content, note_file, mtime_ms): one row per markdown file with text, in any depth's own name."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][dD]").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    out = raw.select(F.concat(F.lit("note:"), F.regexp_replace(name, r"(?i)\.md$", "")).alias("id"), F.decode("content", "UTF-8").alias("content"), name.alias("note_file"), F.unix_millis("modificationTime").alias("mtime_ms"))
    return out.where(F.trim("content") != "")


def write_records(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, one folder per layer. The scope is a field: scopes are many and most of them small, and a file for
    each would be more files than rows are worth."""
    df.write.mode("append").partitionBy("layer").json(path)
