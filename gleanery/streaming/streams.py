"""Structured Streaming forms of the stateful operators.

State is bounded by watermarks, by a budget per session, or lives in a table that each batch
replaces by a new version; every sink is idempotent by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import facts

PRIORITY = {"user": 3, "assistant": 2}


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a time zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(events: DataFrame, late: str = "1 day", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and event type; rows later than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = timed(events).withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "1 day", gap: str = "2 hours") -> DataFrame:
    out = timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


def distinct_once(chunks: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """The first of equal keys within the watermark."""
    return chunks.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def observation_log(turns: DataFrame, max_tokens: int = 600, idle: str | None = None) -> DataFrame:
    """conv_id, turn, action: each kept observation, each one evicted by the budget, and those left when a session ends.

    A session's state is its kept (turn, priority, tokens); it never holds more than the budget
    and one item. It goes when nothing has come for the idle time, such as '1 day'; then the
    stream looks for idle sessions for ever, so it is for triggers that do not end.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = [tuple(x) for x in zip(*state.get)] if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], k[0], "expired") for k in kept], columns=["conv_id", "turn", "action"])
            return
        out = []
        new = pd.concat(list(frames)).sort_values("turn")
        for turn, role, text in zip(new["turn"], new["role"], new["text"]):
            if not text:
                continue
            kept.append((int(turn), PRIORITY.get(role, 1), max(1, -(-len(text) // 4))))
            out.append((key[0], int(turn), "kept"))
            used = sum(k[2] for k in kept)
            while used > max_tokens and len(kept) > 1:
                victim = min(kept, key=lambda k: (k[1], k[0]))
                kept.remove(victim)
                used -= victim[2]
                out.append((key[0], victim[0], "evicted"))
        state.update(tuple(list(c) for c in zip(*kept)) if kept else ([], [], []))
        if wait:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "action"])

    return turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandasWithState(
        run, "conv_id long, turn long, action string", "turns array<long>, priorities array<long>, tokens array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    )


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a table below path, ascending."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    written = [p for p in names if p.getName().startswith("version=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("version=")) for p in written)


def fact_table(arrivals: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str]) -> StreamingQuery:
    """Fold the arrivals of each batch into the newest version of the table below path.

    A batch reads the version before its own and writes its own, so one that is run again
    replaces itself; earlier arrivals are not read again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, path) if v < batch_id]
        rows = facts.folded(spark.read.parquet(f"{path}/version={before[-1]}"), batch, key, order) if before else facts.consolidated(batch, key, order)
        rows.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_facts(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of fact_table()."""
    return spark.read.parquet(f"{path}/version={versions(spark, path)[-1]}")


def summaries(turns: DataFrame, ts: str = "ts", late: str = "1 hour", gap: str = "30 minutes", first: int = 3) -> DataFrame:
    """conv_id, start, turns, summary: each session's first turns in order, once its gap and the watermark have passed."""
    few = F.slice(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), 1, first)
    out = turns.withWatermark(ts, late).groupBy("conv_id", F.session_window(ts, gap)).agg(F.count("*").alias("turns"), few.alias("few"))
    line = F.transform("few", lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return out.select("conv_id", F.col("session_window.start").alias("start"), "turns", F.array_join(line, "\n").alias("summary"))


def unexpired(notes: DataFrame, expires_at: str = "expires_at") -> DataFrame:
    """Notes that have not expired when they are read; those without an expiry stay."""
    return notes.where(F.col(expires_at).isNull() | (F.col(expires_at) >= F.current_timestamp()))


def new_files(spark, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A stream of files that appear below path; the checkpoint knows which were read."""
    return spark.readStream.schema(schema).format(fmt).load(path)
