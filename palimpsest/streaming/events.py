"""The event surface as Structured Streaming: replay-safe appends, logical clocks, latest-wins state, feedback.

Streams run until what is there has been read (`availableNow`), so the same code serves as a job and as a query.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.runtime import shared_dir
from palimpsest.sources import sinks


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A table's files as a stream; a table is a file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parquet*")


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], place: str) -> None:
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{place}/_progress").trigger(availableNow=True).start().awaitTermination()


def work_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def append_once(stream: DataFrame, key: list[str], order: list[str], place: str) -> str:
    """Rows of a stream appended to a table, each key once, whatever is replayed within or across batches. State is the
    table itself, so it is bounded by nothing but the store. Returns the table's path."""
    path = f"{place}/rows"
    run(stream, lambda batch, _: sinks.append_new(batch, path, key, order), place)
    return path


def recent_once(stream: DataFrame, key: list[str], at: str, late: str = "2 days") -> DataFrame:
    """As append_once, but state is kept only for as long as rows may be late: a documented deviation for endless streams."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


CLOCK = "scope string, turns bigint, newest bigint"


def tick(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A scope's logical clock: one turn for each event, and the newest of the events' own turns."""
    turns, newest = state.get if state.exists else (0, 0)
    for pdf in batches:
        turns += len(pdf)
        newest = max(newest, int(pdf["turn"].max()) if pdf["turn"].notna().any() else 0)
    state.update((turns, newest))
    yield pd.DataFrame([(key[0], turns, newest)], columns=["scope", "turns", "newest"])


def clocks(stream: DataFrame) -> DataFrame:
    """(scope, turns, newest) whenever a scope's clock moves."""
    return stream.groupBy("scope").applyInPandasWithState(tick, CLOCK, "turns bigint, newest bigint", "update", GroupStateTimeout.NoTimeout)


def switch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fires once a session has seen a to-do list and then a change of a file, and again after `cooldown` turns at the earliest."""
    seen, fired = state.get if state.exists else (False, -10)
    out = []
    for pdf in batches:
        for r in pdf.sort_values("turn").itertuples():
            seen = seen or r.tool == "todo"
            if seen and r.tool in ("edit", "write") and r.turn - fired > 3:
                fired = int(r.turn)
                out.append((key[0], fired))
    state.update((seen, fired))
    yield pd.DataFrame(out, columns=["scope", "turn"])


def switches(stream: DataFrame) -> DataFrame:
    return stream.groupBy("scope").applyInPandasWithState(switch, "scope string, turn bigint", "seen boolean, fired bigint", "append", GroupStateTimeout.NoTimeout)


def collect_updates(stream: DataFrame, place: str, key: list[str], order: str) -> DataFrame:
    """What an updating stream ends with: its last row for each key."""
    spark, path = stream.sparkSession, f"{place}/updates"
    stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.withColumn("_batch", F.lit(n)).write.mode("append").parquet(path)).option("checkpointLocation", f"{place}/_progress").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*key, "_batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_batch", order)).alias("_b")).select(*key, "_b.*")
