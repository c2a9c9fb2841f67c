"""Structured Streaming twins of the request log operators. Every sink is a folder with its own checkpoint."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from prefloom.functions import text
from prefloom.operators.requests import RATE_LIMIT_TEXT, completion_tokens
from prefloom.sources.files import split_requests


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", save: Callable[[DataFrame, int], None] | None = None) -> dict | None:
    """Process everything that is there, then stop; gives the progress of the last micro-batch. Updates of one batch overwrite nothing: they carry ``batch_id``.
    Streams use the state store that keeps state on disk; the session's own setting comes back once the stream has started."""
    spark = stream.sparkSession
    if mode == "append" and save is None:
        writer = stream.writeStream.format("parquet").option("path", out)
    else:
        # overwriting its own batch folder makes a repeated batch harmless
        def overwrite(df: DataFrame, batch_id: int) -> None:
            df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

        writer = stream.writeStream.outputMode(mode).foreachBatch(save or overwrite)
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
    q.awaitTermination()
    return q.lastProgress


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest value per key of a folder of updates (the last complete batch when there are no keys)."""
    rows = spark.read.parquet(out)
    values = F.struct("batch_id", *[c for c in rows.columns if c not in (*keys, "batch_id")])
    return rows.groupBy(*keys).agg(F.max_by(values, "batch_id").alias("v")).select(*keys, "v.*").drop("batch_id")


def requests(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Request lines that keep arriving in a folder, with their token cost by the fields they carry."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    return with_cost(split_requests(lines))


QUEUE = "task_id bigint, attempt int, request string"


def enqueue(tasks: DataFrame, folder: str) -> None:
    """Put ``task_id, request`` into the queue of ``folder`` as first attempts."""
    tasks.select("task_id", F.lit(0).alias("attempt"), "request").write.mode("append").parquet(f"{folder}/queue/first")


def work_off(spark: SparkSession, folder: str, send: Callable[[DataFrame], DataFrame], max_attempts: int = 5, max_files: int = 100) -> None:
    """The request loop as one stream over its own queue: requests and those that came back. ``send`` adds ``ok, error`` to a batch of attempts.

    Every attempt goes to ``folder/attempts``; one that failed returns to the queue as the next attempt until ``max_attempts`` are spent. Both are written
    to the batch's own folder, so a batch that is repeated after a loss replaces what it wrote before, and the stream's checkpoint covers
    the returned requests as well as the first ones: started again, it goes on where it stopped. A run ends when the files are read that were there when it
    began, so there is one run for each attempt that some request needs."""
    attempts = StructType.fromDDL(f"{QUEUE}, ok boolean, error string")

    def step(df: DataFrame, batch_id: int) -> None:
        send(df).select(*attempts.fieldNames()).write.mode("overwrite").parquet(f"{folder}/attempts/batch_id={batch_id}")
        sent = spark.read.schema(attempts).parquet(f"{folder}/attempts/batch_id={batch_id}")
        again = sent.filter(~F.coalesce("ok", F.lit(False)) & (F.col("attempt") + 1 < max_attempts))
        back = f"{folder}/queue/again-{batch_id}"
        if again.isEmpty():
            # an empty file would be a new batch; what a lost run of this batch left goes
            path = spark._jvm.org.apache.hadoop.fs.Path(back)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        else:
            again.select("task_id", (F.col("attempt") + 1).alias("attempt"), "request").write.mode("overwrite").parquet(back)
        worked.append(batch_id)

    worked: list[int] = [-1]
    while worked:
        worked.clear()
        queue = spark.readStream.schema(QUEUE).option("maxFilesPerTrigger", max_files).parquet(f"{folder}/queue/*")
        run_available(queue, folder, f"{folder}/checkpoint", save=step)


def with_cost(df: DataFrame) -> DataFrame:
    v = F.try_parse_json("request")

    def field(path: str, kind: str) -> Column:
        return F.try_variant_get(v, path, kind)

    texts = F.coalesce(
        field("$.prompt", "array<string>"), F.array_compact(F.array(field("$.prompt", "string"))),
        F.array().cast("array<string>"),
    )
    messages = F.coalesce(field("$.messages", "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    inputs = F.coalesce(field("$.input", "array<string>"), F.array_compact(F.array(field("$.input", "string"))), F.array().cast("array<string>"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, t: s + text.token_count(t))
    chat = F.aggregate(
        messages, F.lit(2),
        lambda s, m: s + 4 + total(F.map_values(m)) - F.when(F.map_contains_key(m, "name"), 1).otherwise(0),
    )
    made = completion_tokens(field("$.n", "int"), field("$.max_tokens", "int"))
    cost = (
        F.when(F.size(messages) > 0, chat + made)
        .when(field("$.input", "variant").isNotNull(), total(inputs))
        .otherwise(total(texts) + made * F.size(texts))
    )
    return df.withColumn("tokens", cost)


def usage(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Requests and tokens per minute; rows later than the watermark are dropped. A minute comes out once the watermark has passed it, so a log that ends
    needs a last row well behind its end."""
    w = log.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute").alias("w"))
    return w.agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens")).select(
        F.col("w.start").alias("minute"), "requests", "tokens"
    )


def cooldowns(log: DataFrame, seconds: int = 15, delay: str = "1 hour", shards: int = 16) -> DataFrame:
    """Cool-down spans as session windows over rate-limit errors, kept per shard of the log by a hash of the task.

    Sessions of one key live in one task, so the log is dealt out; spans of different shards overlap and are merged by the batch operator
    ``merge_spans``. Session windows join spans that touch, so they are kept one microsecond short and lengthened afterwards: as in the batch
    operator, an error at the end of a span opens a new one. The watermark sees all rows of the log, not the errors alone.
    """
    # a condition on the time as well, or the filter would be pushed below the watermark
    limited = F.when(F.col("ts").isNotNull(), F.col("error").contains(RATE_LIMIT_TEXT))
    hits = log.withWatermark("ts", delay).filter(limited)
    shard = F.pmod(F.xxhash64("task_id", "attempt"), F.lit(shards)).alias("shard")
    g = hits.groupBy(F.session_window("ts", f"{seconds * 1_000_000 - 1} microseconds").alias("s"), shard)
    return g.agg(F.count(F.lit(1)).alias("n_errors")).select(
        "shard", F.col("s.start").alias("start"), (F.col("s.end") + F.expr("INTERVAL '0.000001' SECOND")).alias("end"), "n_errors"
    )


def task_status(log: DataFrame, max_attempts: int = 5, delay: str = "1 hour", remember: str = "365 days") -> DataFrame:
    """Emits each task once with its errors in order: on its first success, or when ``max_attempts`` errors came first.

    A task is remembered until the watermark is ``remember`` behind its last row, so state does not
    grow with the length of the log; a task that comes back later starts anew. Needs the state store of :func:`run_available`."""
    return _tasks(log, task_processor(max_attempts, int(pd.Timedelta(remember).total_seconds() * 1000), changes=False), delay)


def task_changes(log: DataFrame, max_attempts: int = 5, delay: str = "1 hour", remember: str = "365 days") -> DataFrame:
    """Each task once as ``started`` and once as ``succeeded`` or ``failed``: what running counters add up."""
    return _tasks(log, task_processor(max_attempts, int(pd.Timedelta(remember).total_seconds() * 1000), changes=True), delay)


def task_processor(max_attempts: int, wait: int, changes: bool) -> StatefulProcessor:
    """State of a task: one value of its status, its errors so far, the end of its memory and the timer set for it. A call reads and writes that value
    once, and a timer that is too early is set anew when it ends, not with each row: every such step is a message to the state store. The class is made
    here, so that it travels by value: the process in which Spark sets up the state has no package from the session."""

    class TaskState(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.task = handle.getValueState("task", "status string, errors array<string>, until bigint, timer bigint")

        def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803  names of the interface
            before = self.task.get()
            status, errors, _, timer = before if before else (None, [], None, None)
            errors = list(errors or [])
            last: list[int] = []

            def seen() -> Iterator[Row]:
                for r in rows:
                    last[:] = [max([r["at"], *last])]
                    yield r

            order = lambda r: (r["at"], r["attempt"] is None, r["attempt"] or 0)
            # among any max_attempts rows in order the task is decided, so no more than these are kept
            first = heapq.nsmallest(max_attempts, seen(), key=order)
            news = ["started"] if status is None else []
            if first and status in (None, "pending"):
                status = "pending"
                for r in first:
                    if not r["ok"]:
                        errors.append(r["error"])
                    if r["ok"] or len(errors) >= max_attempts:
                        status = "succeeded" if r["ok"] else "failed"
                        news.append(status)
                        break
            if last:
                until = max(last[0] // 1000, timerValues.getCurrentWatermarkInMs()) + wait
                if timer is None or until < timer:
                    if timer is not None:
                        self.handle.deleteTimer(timer)
                    self.handle.registerTimer(timer := until)
                self.task.update((status, errors if status == "pending" else [], until, timer))
            if changes:
                for change in news:
                    yield Row(task_id=key[0], status=change, errors=None)
            elif news and news[-1] != "started":
                yield Row(task_id=key[0], status=status, errors=errors)

        def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
            status, errors, until, _ = self.task.get()
            if until > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(until)
                self.task.update((status, list(errors or []), until, until))
            else:
                self.task.clear()
            yield from ()

        def close(self) -> None:
            pass

    return TaskState()


def _tasks(log: DataFrame, processor: StatefulProcessor, delay: str) -> DataFrame:
    rows = log.withWatermark("ts", delay).filter(F.when(F.col("ts").isNotNull(), F.col("task_id").isNotNull()))
    rows = rows.select("task_id", "ts", F.unix_micros("ts").alias("at"), "attempt", "ok", "error")
    return rows.groupBy("task_id").transformWithState(processor, "task_id long, status string, errors array<string>", "Append", "EventTime")


def add_up(changes: DataFrame, batch_id: int, out: str) -> None:
    """Counters of one micro-batch of :func:`task_changes`: three rows at most, in a folder of their own that a repeated batch overwrites."""
    changes.groupBy("status").count().coalesce(1).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def task_counters(spark: SparkSession, out: str) -> DataFrame:
    """``started, in_progress, succeeded, failed`` from the counters of all micro-batches."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("count"))), F.lit(0))
    counted = spark.read.schema("status string, count bigint, batch_id bigint").parquet(out)
    rows = counted.agg(*[of(s).cast("bigint").alias(s) for s in ("started", "succeeded", "failed")])
    return rows.select("started", (F.col("started") - F.col("succeeded") - F.col("failed")).alias("in_progress"), "succeeded", "failed")


def error_counts(log: DataFrame) -> DataFrame:
    """Running counters of errors by kind."""
    limited = F.col("api") & F.col("error").contains(RATE_LIMIT_TEXT)
    bad = ~F.col("ok")
    return log.groupBy().agg(
        F.count_if(bad & limited).alias("rate_limit_errors"),
        F.count_if(bad & F.col("api") & ~limited).alias("api_errors"), F.count_if(bad & ~F.col("api")).alias("other_errors"),
    )


def eval_means(generations: DataFrame, metrics: list[str]) -> DataFrame:
    """Running means per run while generations arrive."""
    return generations.groupBy("run").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics])

