"""Streaming forms of the server's counters, queues and sessions.

The reference works in the order of arrival; here event time counts, with a watermark of ten minutes unless
said otherwise. Each function takes and gives a streaming DataFrame; run() drives one to its end and gives the table it made."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera import scratch

LATE = "10 minutes"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    base = spark.read.parquet(f"{sf_dir}/events.parquet").inputFiles()
    # A single file or a folder of parts: the stream lists the folder that holds it, and takes the table's files only.
    folder = f"{sf_dir}/events.parquet" if any("/events.parquet/" in f for f in base) else sf_dir
    if folder == sf_dir:
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return stream.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run(df: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """All that is there now through the stream, into a table; complete and update results are kept as the last batch gives them.

    In complete mode state grows with the windows; a stream that goes on for ever is run in append mode, where a
    window leaves the state once the watermark has passed it."""
    spark = df.sparkSession
    out, state = scratch.path(spark, name), scratch.path(spark, f"{name}-state")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(out)

    q = df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def tumbling(df: DataFrame, size: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums per window and key."""
    agg = df.withWatermark("ts", LATE).groupBy(F.window("ts", size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return agg.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(df: DataFrame, size: str, step: str, keys: list[str], value: str) -> DataFrame:
    """X10."""
    agg = df.withWatermark("ts", LATE).groupBy(F.window("ts", size, step), *keys).agg(F.avg(value).alias("mean"))
    return agg.select(F.col("window.start").alias("start"), *keys, "mean")


def sessions(df: DataFrame, gap: str, key: str) -> DataFrame:
    """X11: runs of a key's events with no gap as long as that between them."""
    agg = df.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_events(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Repeats within the watermark dropped."""
    return df.withWatermark("ts", LATE).dropDuplicatesWithinWatermark([key])


def answered(requests: DataFrame, results: DataFrame, within: str) -> DataFrame:
    """requests(req_key, req_id, req_ts) with results(res_key, res_id, res_ts) of the same key that came within a time."""
    left, right = requests.withWatermark("req_ts", LATE), results.withWatermark("res_ts", LATE)
    on = f"req_key = res_key AND res_ts > req_ts AND res_ts <= req_ts + interval {within}"
    return left.join(right, F.expr(on)).withColumn("seconds", F.unix_micros("res_ts") / 1e6 - F.unix_micros("req_ts") / 1e6)


def gathered(df: DataFrame, keep_ms: int = 3_600_000) -> DataFrame:
    """partial(task_id, idx, kind, text[, ts]): texts of a task in the order of idx, given once its final part has come;
    a cancelled task gives nothing. State: the parts so far, per task.

    With a time column ts, state ends when the watermark is keep_ms past a task's last part, so neither a task that never ends nor
    the mark of one that has, by which late parts are known, stays for ever. Without one there is nothing to tell when."""
    timed = "ts" in df.columns

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, last_at = list(zip(*state.get, strict=True)) if state.exists else [], 0
        for pdf in parts:
            held += list(zip(pdf["idx"].tolist(), pdf["kind"].tolist(), pdf["text"].tolist(), strict=True))
            if timed:
                last_at = max(last_at, int(pdf["ts"].max().timestamp() * 1000))
        kinds = {k for _, k, _ in held}
        keep, out = held, None
        if "cancel" in kinds or "done" in kinds:
            keep = [(-1, "done", "")]
        elif "final" in kinds:
            last = min(i for i, k, _ in held if k == "final")
            got = {i: t for i, _, t in held if i <= last}
            if len(got) == last + 1:
                keep = [(-1, "done", "")]
                out = pd.DataFrame({"task_id": [key[0]], "n_parts": [len(got)], "text": ["".join(got[i] for i in sorted(got))]})
        if keep:
            state.update(tuple(map(list, zip(*keep, strict=True))))
            if timed:
                state.setTimeoutTimestamp(max(last_at, state.getCurrentWatermarkMs()) + keep_ms)
        if out is not None:
            yield out

    rows = df.withWatermark("ts", LATE) if timed else df
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return rows.groupBy("task_id").applyInPandasWithState(step, "task_id long, n_parts long, text string", "idx array<long>, kind array<string>, text array<string>", "append", timeout)


def slot_queue(df: DataFrame, slots: int = 1) -> DataFrame:
    """tasks(server, ts, task_id, seconds) of a server with some slots, first come first served: when each starts and how long it waits.

    Times are whole microseconds, so sums are exact. State: when each slot is free again. Within a micro-batch a server's tasks are taken in the order of time."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = sorted(state.get[0]) if state.exists else [0] * slots
        pdf = pd.concat(list(parts)).sort_values(["at", "task_id"])
        start = []
        for at, lasts in zip(pdf["at"].tolist(), pdf["lasts"].tolist(), strict=True):
            begin = max(at, free[0])
            free = sorted([*free[1:], begin + lasts])
            start.append(begin)
        state.update((free,))
        yield pd.DataFrame({"server": key[0], "task_id": pdf["task_id"].to_numpy(), "waited": [(s - a) / 1e6 for s, a in zip(start, pdf["at"].tolist(), strict=True)]})

    rows = df.select("server", "task_id", F.round(F.col("seconds") * 1e6).cast("bigint").alias("lasts"), F.unix_micros("ts").alias("at"))
    return rows.groupBy("server").applyInPandasWithState(step, "server long, task_id long, waited double", "free array<bigint>", "append", GroupStateTimeout.NoTimeout)


def pair_counts(df: DataFrame, key: str, token: str) -> DataFrame:
    """Per stream, how often a token follows another, from state that holds the last token of the stream; each batch gives what it added."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        tokens = pd.concat(list(parts)).sort_values(["ts", "event_id"])[token].tolist()
        seq = ([last] if last is not None else []) + tokens
        state.update((tokens[-1] if tokens else last,))
        pairs = pd.Series(list(zip(seq, seq[1:], strict=False)), dtype=object).value_counts()
        yield pd.DataFrame({key: [k[0]] * len(pairs), "prev": [p[0] for p in pairs.index], "next": [p[1] for p in pairs.index], "cnt": pairs.to_numpy()})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} long, prev string, next string, cnt long", "last string", "append", GroupStateTimeout.NoTimeout)
