"""Structured Streaming forms: reassembly, pairs, deadlines, cached identities, probes, metrics, masking, ingestion, loss."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.functions.tables import shared_path
from brindle.operators.detect import all_findings
from brindle.operators.masking import instructions, mask_text

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession, provider: str | None):
    """Streams that start inside keep their state in a store of the class given; the session's setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    if provider:
        spark.conf.set(PROVIDER, provider)
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(PROVIDER, before)
        elif provider:
            spark.conf.unset(PROVIDER)


def run_available(df: DataFrame, mode: str = "append", store: str | None = None) -> DataFrame:
    """Run a stream over all that its sources have, into a table of the shared folder, and read that."""
    spark = df.sparkSession
    out, check = shared_path(spark, "stream"), shared_path(spark, "offsets")
    with state_store(spark, store):
        q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def batch_sink(out: str):
    """A sink that holds each batch once, however often it is given: a batch is a folder of its number, which is replaced."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_id", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return put


def run_batches(df: DataFrame, mode: str = "update", store: str | None = None, out: str | None = None, check: str | None = None, sink=batch_sink) -> DataFrame:
    """As run_available for results that change: each batch is written with its number, batch_id.

    With paths of its own for results and checkpoint, a run that was stopped goes on where it was: the batch that had not
    been committed runs again with its number and its rows, on the state before it, and takes the place of what it left.
    """
    spark = df.sparkSession
    out, check = out or shared_path(spark, "stream"), check or shared_path(spark, "offsets")
    with state_store(spark, store):
        q = df.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(sink(out)).start()
    q.awaitTermination()
    schema = df.withColumn("batch_id", F.lit(0).cast("bigint")).schema
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)


def write_in_order(df: DataFrame, path: str, steps: int = 4, files: int = 2, closing: str | None = None, marks: dict | None = None) -> None:
    """Write df (with ts) to path in steps by ranges of time, each of `files` files, so that a stream that takes `files`
    files a batch sees the steps one after another; closing adds a row that much later, with the values of marks (a join key
    must not be null there: rows that cannot join are filtered out before they move the watermark)."""
    spark = df.sparkSession
    ends = df.select(F.unix_micros("ts").alias("t")).agg(F.percentile_approx("t", [k / steps for k in range(1, steps + 1)], 1000).alias("q"), F.max("t").alias("most")).first()
    low = None
    for k in range(steps):
        t = F.unix_micros("ts")
        high = ends.most if k == steps - 1 else ends.q[k]
        part = df.where((t <= high) if low is None else (t > low) & (t <= high)) if high is not None else df
        part.repartition(files).write.mode("append").parquet(path)
        low = high
    if closing:
        last = spark.range(1).select(F.expr(f"timestamp_micros({ends.most or 0}) + INTERVAL {closing}").alias("ts"))
        values = [F.col("ts") if f.name == "ts" else F.lit((marks or {}).get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema]
        last.select(*values).repartition(1).write.mode("append").parquet(path)


def stream_table(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a path, its schema taken from the files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def in_order(pdfs, by: list[str]):
    """Rows of a key in one batch, in order: a key's rows may come in several Arrow chunks, whose order is that of the shuffle."""
    chunks = list(pdfs)
    return pd.concat(chunks).sort_values(by).itertuples() if chunks else iter(())


#: Groups that streams, spans and subjects are dealt to: a group's state is read and written once a batch, not once a key.
GROUPS = 256


def reassemble_live(deltas: DataFrame, idle: str = "10 minutes", groups: int = GROUPS) -> DataFrame:
    """(stream_id, status, text, n) of each stream (stream_id, seq, delta, done, failed, ts): COMPLETE at its end, FAILED at an
    error event, which discards the text, or after the idle time without an end. Streams are dealt to groups by a hash; what
    is open in a group is its state, with a timeout at the first idle time that ends."""
    late = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key, pdfs, state: GroupState):
        open_ = {s: [at, list(q), list(t)] for s, at, q, t in zip(*state.get, strict=True)} if state.exists else {}
        now, new, ended = state.getCurrentWatermarkMs(), {}, {}
        for pdf in () if state.hasTimedOut else pdfs:
            for s, q, t, done, failed, at in zip(*(pdf[c].tolist() for c in ("stream_id", "seq", "delta", "done", "failed", "at")), strict=True):
                one = open_.setdefault(s, [None, [], []])
                one[1].append(int(q))
                one[2].append(t or "")
                new[s] = max(new.get(s, at), at)
                if done or failed:
                    ended[s] = "FAILED" if failed or ended.get(s) == "FAILED" else "COMPLETE"
        for s, at in new.items():
            open_[s][0] = max(at + late, now + 1)
        for s, one in open_.items():
            if s not in new and one[0] <= now:
                ended[s] = "FAILED"
        rows = []
        for s, status in ended.items():
            _, seqs, texts = open_.pop(s)
            rows.append((s, status, "" if status == "FAILED" else "".join(t for _, t in sorted(zip(seqs, texts, strict=True))), len(seqs)))
        if open_:
            state.update((list(open_), *([x[k] for x in open_.values()] for k in range(3))))
            state.setTimeoutTimestamp(max(min(x[0] for x in open_.values()), now + 1))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=["stream_id", "status", "text", "n"])

    dealt = deltas.withWatermark("ts", idle).withColumn("at", F.unix_millis("ts")).withColumn("group", F.pmod(F.xxhash64("stream_id"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandasWithState(
        step, "stream_id string, status string, text string, n long", "streams array<string>, due array<long>, seqs array<array<long>>, texts array<array<string>>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )


def pair_stream(started: DataFrame, completed: DataFrame, limit: str = "1 hour") -> DataFrame:
    """Starts with their end within the limit; the end is null once the watermark has passed it."""
    s = started.select("span_id", F.col("ts").alias("started_ts")).withWatermark("started_ts", limit)
    c = completed.select(F.col("span_id").alias("c_span"), F.col("ts").alias("completed_ts")).withWatermark("completed_ts", limit)
    on = (F.col("span_id") == F.col("c_span")) & (F.col("completed_ts") >= F.col("started_ts")) & (F.col("completed_ts") <= F.col("started_ts") + F.expr(f"INTERVAL {limit}"))
    return s.join(c, on, "leftOuter").select("span_id", "started_ts", "completed_ts")


class DeadlineProcessor(StatefulProcessor):
    """Open spans of a group with their starts and ends, and a timer at the next deadline among them. An end that comes in time
    takes its start away. Either may come first."""

    def __init__(self, limit_ms: int, kind: str):
        self.limit, self.kind = limit_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", f"spans array<{self.kind}>, started array<long>, completed array<long>")

    def _load(self) -> dict:
        known = self.open.get()
        return {s: (a, b) for s, a, b in zip(*known, strict=True)} if known else {}

    def _due(self, times: tuple) -> int:
        return (times[1] if times[0] is None else times[0]) + self.limit

    def _store(self, spans: dict) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not spans:
            self.open.clear()
            return
        self.open.update((list(spans), [a for a, _ in spans.values()], [b for _, b in spans.values()]))
        self.handle.registerTimer(min(map(self._due, spans.values())))

    def handleInputRows(self, key, rows, timerValues):
        spans, seen = self._load(), set()
        for pdf in rows:
            for span, ended, at in zip(pdf["span_id"].tolist(), pdf["ended"].tolist(), pdf["at"].tolist(), strict=True):
                started, completed = spans.get(span, (None, None))
                if ended:
                    completed = at if completed is None else min(completed, at)
                else:
                    started = at if started is None else min(started, at)
                spans[span] = (started, completed)
                seen.add(span)
        for span in seen:
            started, completed = spans[span]
            if started is not None and completed is not None and completed <= started + self.limit:
                del spans[span]
        self._store(spans)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        spans, late = {}, []
        for span, times in self._load().items():
            if self._due(times) > now:
                spans[span] = times
            elif times[0] is not None:
                late.append((span, "ERROR", "POLICY_DEADLINE_EXCEEDED"))
        self._store(spans)
        yield pd.DataFrame(late, columns=["span_id", "status", "error_code"], dtype=object)

    def close(self) -> None:
        pass


def deadlines(started: DataFrame, completed: DataFrame, limit: str = "50 milliseconds", late: str = "1 second", groups: int = GROUPS) -> DataFrame:
    """(span_id, status, error_code) of policies that did not end within the deadline, each in the batch whose watermark passes
    its deadline. Needs RocksDB as state store.

    Spans are dealt to groups by a hash. A start sets its group's timer in event time, an end in time removes it, and with
    either the state of the span is gone. An end without a start is forgotten after the limit. A bounded input ends with a late
    pair of rows (write_in_order adds it).
    """
    spark = started.sparkSession
    limit_ms = spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {limit}) AS t").first().t
    rows = started.select("span_id", "ts", F.lit(False).alias("ended")).unionByName(completed.select("span_id", "ts", F.lit(True).alias("ended")))
    rows = rows.withWatermark("ts", late).where("span_id is not null").withColumn("at", F.unix_millis("ts"))
    kind = started.schema["span_id"].dataType.simpleString()
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("span_id"), F.lit(groups)))
    return dealt.groupBy("group").transformWithStateInPandas(DeadlineProcessor(limit_ms, kind), f"span_id {kind}, status string, error_code string", "append", "EventTime")


def cached_identities(lookups: DataFrame, ttl_seconds: int = 300, groups: int = GROUPS) -> DataFrame:
    """(subject, event_id, cache): HIT within the TTL of the last written success, else MISS; failures are not cached.

    Batches must come in the order of time; rows of one batch are put in order here. Subjects are dealt to groups by a hash; a
    group's state is the last write of each of its subjects.
    """

    def step(key, pdfs, state: GroupState):
        written = dict(zip(*state.get, strict=True)) if state.exists else {}
        out = []
        for r in in_order(pdfs, ["ts", "event_id"]):
            subject = None if r.nobody else r.subject
            now, at = r.ts.value // 1000, written.get(subject)
            hit = at is not None and now < at + ttl_seconds * 1_000_000
            if not hit and r.ok:
                written[subject] = now
            out.append((subject, r.event_id, "HIT" if hit else "MISS"))
        if written:
            state.update((list(written), list(written.values())))
        if out:
            yield pd.DataFrame(out, columns=["subject", "event_id", "cache"]).astype({"subject": "Int64"})

    dealt = lookups.withColumn("group", F.pmod(F.xxhash64("subject"), F.lit(groups))).withColumn("nobody", F.col("subject").isNull())
    # a null among them would make doubles of the subjects
    return dealt.withColumn("subject", F.coalesce("subject", F.lit(0))).groupBy("group").applyInPandasWithState(
        step, "subject long, event_id long, cache string", "subjects array<long>, written array<long>", "append", GroupStateTimeout.NoTimeout
    )


def probe_signal_stream(probes: DataFrame, run: int = 3) -> DataFrame:
    """(probe, probe_id) when `run` failures in a row are reached; a 200 resets. Batches must come in the order of time;
    rows of one batch are put in order here."""

    def step(key, pdfs, state: GroupState):
        n = state.get[0] if state.exists else 0
        out = []
        for r in in_order(pdfs, ["ts", "probe_id"]):
            n = 0 if r.status == 200 else n + 1
            if n == run:
                out.append((key[0], r.probe_id))
        state.update((n,))
        yield pd.DataFrame(out, columns=["probe", "probe_id"])

    return probes.groupBy("probe").applyInPandasWithState(step, "probe long, probe_id long", "n int", "append", GroupStateTimeout.NoTimeout)


def metrics_stream(exchanges: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(window_start, status_class, n, p95_ms) by tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        exchanges.withWatermark("ts", late).groupBy(w.alias("w"), F.floor(F.col("status") / 100).cast("int").alias("status_class"))
        .agg(F.count("*").alias("n"), F.percentile_approx("duration_ms", 0.95).alias("p95_ms"))
        .select(F.col("w.start").alias("window_start"), "status_class", "n", "p95_ms")
    )


def sessions_stream(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(session_id, from_ts, to_ts, n) of sessions that end after a gap."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "session_id").agg(F.count("*").alias("n"))
    return s.select("session_id", F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "n")


def mask_stream(docs: DataFrame, types: list[str], policies: DataFrame | None = None) -> DataFrame:
    """(docs, findings, masked) of a stream of texts: stateless, and joined to a static policy table by source if given."""
    found = docs.withColumn("findings", all_findings(F.coalesce(F.col("text"), F.lit("")), types))
    out = found.withColumn("masked", mask_text(F.col("text"), instructions(F.col("findings"))))
    if policies is None:
        return out
    p = policies.select("source", "on_detected")
    out = out.join(p, "source", "left")
    return out.withColumn("decision", F.when((F.size("findings") > 0) & (F.col("on_detected") == "BLOCK"), "BLOCK").when(F.size("findings") > 0, "MASK").otherwise("ALLOW"))


def ingest_once(events: DataFrame, keys: list[str], within: str = "1 hour") -> DataFrame:
    """Events without the repeats that come within the time given."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def delivered_stream(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, n) of delivered events; lost_events compares it with what was expected."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def lost_events(expected: DataFrame, delivered: DataFrame) -> DataFrame:
    """(window_start, n_expected, n, lost); windows without any delivered event are lost as a whole."""
    out = expected.join(delivered, "window_start", "left").na.fill(0, ["n"])
    return out.withColumn("lost", F.col("n_expected") - F.col("n"))
