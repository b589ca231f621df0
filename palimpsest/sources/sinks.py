"""Writes of the record model, as tables in a shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.runtime import cut


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def new_rows(incoming: DataFrame, existing: DataFrame | None, key: list[str], order: list[str]) -> DataFrame:
    """The first incoming row of each key that isn't there yet."""
    body = F.struct(*incoming.columns)
    once = incoming.groupBy(*key).agg(F.min_by(body, F.struct(*order, F.xxhash64(F.to_json(body)))).alias("_b")).select("_b.*")
    return once if existing is None else once.join(existing.select(*key).distinct(), key, "left_anti")


def append_new(incoming: DataFrame, path: str, key: list[str], order: list[str]) -> int:
    """Insert-if-absent; running it again adds nothing. Returns how many rows were added."""
    spark = incoming.sparkSession
    fresh = cut(new_rows(incoming, spark.read.parquet(path) if exists(spark, path) else None, key, order))
    n = fresh.count()
    if n or not exists(spark, path):
        fresh.write.mode("append").parquet(path)
    return n


def upsert_derived(existing: DataFrame, incoming: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after the upsert, refused rows). incoming(id, scope, layer, topic, sourceRefs, seq): a row without references, of
    layer L0, or with a reference that isn't in known(id) is refused; the others supersede the active rows of their topic."""
    refs = incoming.select("id", F.explode_outer("sourceRefs").alias("ref"))
    ok = refs.join(known.select(F.col("id").alias("ref"), F.lit(1).alias("_k")), "ref", "left").groupBy("id").agg((F.count("ref") > 0).alias("_some"), (F.count("ref") == F.count("_k")).alias("_all"))
    judged = incoming.join(ok, "id")
    good = (F.col("layer") != "L0") & F.col("_some") & F.col("_all")
    fine = judged.where(good).drop("_some", "_all")
    rows = existing.unionByName(fine, allowMissingColumns=True)
    successor = F.when(F.col("topic").isNotNull() & F.col("supersededBy").isNull(), F.lead("id").over(W.partitionBy("scope", "topic").orderBy("seq", "id")))
    after = rows.withColumn("supersededBy", F.coalesce("supersededBy", successor))
    return after, judged.where(~good).select("id")


def patch(existing: DataFrame, patches: DataFrame, columns: list[str]) -> DataFrame:
    """existing with the columns that patches(id, columns) has values for; ids that aren't there are ignored."""
    p = patches.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
    j = existing.join(p, "id", "left")
    return j.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in existing.columns])


def replace_version(df: DataFrame, root: str) -> str:
    """Writes a whole new version beside the old ones and then points to it; readers see one or the other."""
    import uuid

    spark = df.sparkSession
    path = f"{root}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").text(f"{root}/_current")
    return path


def current_version(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(spark.read.text(f"{root}/_current").first()[0])


def latest(df: DataFrame, key: list[str], seq: str, columns: list[str]) -> DataFrame:
    """The row with the highest seq of each key."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*columns), seq).alias("_b")).select(*key, "_b.*")


def note_lines(notes: DataFrame) -> DataFrame:
    """(file, text): bullets appended to a category's file, under a heading. notes(category, line, seq)."""
    name = F.concat(F.regexp_replace(F.trim(F.lower("category")), r"[^\w\-]+", "-"), F.lit(".md"))
    rows = notes.groupBy(name.alias("file")).agg(F.first("category").alias("category"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: F.concat(F.lit("- "), x["line"])).alias("l"))
    return rows.select("file", F.concat(F.lit("# "), "category", F.lit("\n"), F.array_join("l", "\n"), F.lit("\n")).alias("text"))


def write_notes(files: DataFrame, folder: str) -> int:
    """files(file, text) written as files of that name below the shared folder, whole ones at a time; how many there are.
    A task that runs again writes the same."""
    import uuid

    import pandas as pd

    def write(batches):
        import posixpath

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for pdf in batches:
            for name, text in zip(pdf["file"], pdf["text"], strict=True):
                path, own = posixpath.join(root, name), posixpath.join(root, f".{name}.{uuid.uuid4().hex}")
                with store.open_output_stream(own) as out:
                    out.write(text.encode())
                store.move(own, path)
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.select("file", "text").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
