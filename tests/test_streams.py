"""Streams over several micro-batches with a late row and a restart in between, against the batch operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from prefloom.operators import requests
from prefloom.session import scratch
from prefloom.streaming import streams

SCHEMA = "task_id long, ts timestamp, attempt long, ok boolean, api boolean, error string, tokens long"
START = datetime(2024, 1, 1)


def made_log():
    """Six hours of attempts by 40 tasks in order, with errors exactly 15 seconds apart among them."""
    rng, at, rows = random.Random(4), START, []
    while at < START + timedelta(hours=6):
        at += timedelta(seconds=rng.choice([1, 15, 15, 40, 300]))
        ok = rng.random() < 0.1
        error = None if ok else rng.choice(["Rate limit reached", "Rate limit reached", "timeout"])
        rows.append((rng.randrange(40), at, len(rows), ok, True, error, rng.randrange(50)))
    return rows


class Folder:
    """A log that grows file by file and is read by a stream one file at a time."""

    def __init__(self, spark, name):
        self.spark, self.path = spark, scratch(spark, name)

    def add(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/log")

    def run(self, query, name, mode="append"):
        out = f"{self.path}/{name}"
        save = (lambda df, k: streams.add_up(df, k, out)) if name == "changes" else None
        return streams.run_available(query(self.stream()), out, f"{self.path}/ckpt-{name}", mode, save)

    def out(self, name):
        return self.spark.read.parquet(f"{self.path}/{name}")


@pytest.fixture(scope="module")
def two_runs(spark):
    """All streams, stopped after three files and started again with the same checkpoints over four more."""
    rows, folder = made_log(), Folder(spark, "streams")
    cuts = [rows[k : k + len(rows) // 6 + 1] for k in range(0, len(rows), len(rows) // 6 + 1)]
    kinds = {
        "usage": (streams.usage, "append"), "cool": (lambda s: streams.cooldowns(s, shards=3), "append"),
        "tasks": (streams.task_status, "append"), "changes": (streams.task_changes, "append"), "errors": (streams.error_counts, "update"),
    }
    late = (1, START, 10**6, False, True, "timeout", 7)  # hours behind the watermark by then
    marker = (None, rows[-1][1] + timedelta(hours=3), None, None, None, None, None)
    for part in (cuts[:3], [*cuts[3:], [late], [marker]]):
        for file in part:
            folder.add(file)
        for name, (query, mode) in kinds.items():
            folder.run(query, name, mode)
    return spark.createDataFrame(rows, SCHEMA), folder


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_usage_equals_the_table_without_the_late_row(two_runs):
    log, folder = two_runs
    assert tuples(folder.out("usage")) == tuples(requests.usage(log, 1, 1).select("minute", "requests", "tokens"))


def test_spans_of_shards_equal_the_table(two_runs):
    log, folder = two_runs
    assert folder.out("cool").select("shard").distinct().count() > 1
    assert tuples(requests.merge_spans(folder.out("cool").drop("shard"), rows=7)) == tuples(requests.cooldowns(log).select("start", "end", "n_errors"))


def test_each_task_is_decided_once_with_its_errors(two_runs):
    log, folder = two_runs
    want = requests.task_status(log).filter("status <> 'pending'").select("task_id", "status", F.array_join("errors", ",").alias("e"))
    got = folder.out("tasks").select("task_id", "status", F.array_join("errors", ",").alias("e"))
    assert tuples(got) == tuples(want)


def test_counters_equal_the_table(two_runs, spark):
    log, folder = two_runs
    states = streams.task_counters(spark, f"{folder.path}/changes").first()
    want = requests.status_counts(log).first()
    assert tuple(states) == tuple(want)[:4]
    errors = streams.latest(spark, f"{folder.path}/errors", []).first()
    assert errors["rate_limit_errors"] == want["rate_limit_errors"]
    assert errors["api_errors"] == want["api_errors"] + 1  # running counters know no lateness


def test_decided_tasks_are_forgotten_in_time(spark):
    folder = Folder(spark, "expiry")
    day = timedelta(days=1)
    for k, task in enumerate([1, 1, 2, 2, 2, 1]):
        folder.add([(task, START + k * day / 2 if k < 2 else START + k * 3 * day, k, True, True, None, 1)])
    folder.run(lambda s: streams.task_status(s, remember="1 day"), "tasks")
    # the second row of task 1 finds its state, the last one comes after that has ended
    assert sorted(r["task_id"] for r in folder.out("tasks").collect()).count(1) == 2


def test_state_falls_as_time_passes(spark):
    folder = Folder(spark, "falling")

    def rows_in_state(tasks, day):
        folder.add([(t, START + timedelta(days=day), 0, False, True, "timeout", 1) for t in tasks])
        progress = folder.run(lambda s: streams.task_status(s, remember="2 days"), "tasks")
        return sum(o["numRowsTotal"] for o in progress["stateOperators"])

    full = rows_in_state(range(100), 0)
    rows_in_state([1000], 9)
    rows_in_state([1001], 18)
    assert rows_in_state([1002], 27) < full / 10


def test_the_state_store_of_the_session_is_left_alone(spark):
    assert spark.conf.get(streams.STORE, None) != streams.ROCKS


def test_requests_come_back_until_they_succeed_or_are_spent(spark):
    path = scratch(spark, "queue")
    tasks = spark.createDataFrame([(k, f"r{k}") for k in range(50)], "task_id long, request string")
    streams.enqueue(tasks, path)
    calls = []

    def send(df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        ok = F.col("attempt") >= F.col("task_id") % 7
        return df.withColumn("ok", ok).withColumn("error", F.when(~ok, "timeout"))

    with pytest.raises(Exception, match="lost"):
        streams.work_off(spark, path, send, max_files=1)
    streams.enqueue(spark.createDataFrame([(50, "late")], "task_id long, request string"), path)
    streams.work_off(spark, path, send, max_files=1)
    tried = spark.read.parquet(f"{path}/attempts")
    got = {r.task_id: (r.n, r.won) for r in tried.groupBy("task_id").agg(F.count("*").alias("n"), F.max("ok").alias("won")).collect()}
    assert got == {k: (min(k % 7 + 1, 5), k % 7 < 5) for k in range(51)}
    assert tried.select("task_id", "attempt").distinct().count() == tried.count()
    assert requests.pending(tasks, tried.filter("ok"), tried.select("task_id", "ok")).count() == 0


def test_a_call_sends_few_messages_and_memory_lasts_from_the_last_row(spark):
    sent = []

    class Handle:
        value = None

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def get(self):
            sent.append("get")
            return self.value

        def update(self, value):
            sent.append("update")
            self.value = value

        def clear(self):
            self.value = None

        def registerTimer(self, at):  # noqa: N802
            sent.append(("timer", at))

    class Times:
        at = 0

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.at

    task, handle, now = streams.task_processor(3, 1000, changes=False), Handle(), Times()
    task.init(handle)
    rows = lambda *at: iter([{"at": t * 1000, "attempt": t, "ok": False, "error": f"e{t}"} for t in at])
    assert [*task.handleInputRows((7,), rows(20, 10), now)] == []
    assert sent == ["get", ("timer", 1020), "update"]
    sent.clear()
    assert [(r.status, r.errors) for r in task.handleInputRows((7,), rows(500, 40, 30), now)] == [("failed", ["e10", "e20", "e30"])]
    assert sent == ["get", "update"]
    now.at = 1100  # the timer of the first rows ends before the memory of the last one
    assert [*task.handleExpiredTimer((7,), now, None)] == [] and sent[-2:] == [("timer", 1500), "update"] and handle.value[0] == "failed"
    now.at = 1600
    assert [*task.handleExpiredTimer((7,), now, None)] == [] and handle.value is None
