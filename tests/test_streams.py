"""Streams with timers: deadlines and the bounded cache, against plain folds, batch by batch."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.streaming import streams as st
from brindle.streaming.cache import COALESCED, EXPIRED, HIT, MISS, SIZE, CacheFold, cache_report, cache_stream

START = 1_700_000_000


def progress_of(df, tmp_path):
    """(rows with the batch that wrote them, progress of the last batch) of a stream run to its end."""
    got = []

    def put(batch, number):
        got.extend((*r, number) for r in batch.collect())

    with st.state_store(df.sparkSession, st.ROCKSDB):
        q = df.writeStream.option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return got, q.recentProgress


def test_deadlines_come_with_the_watermark_and_leave_no_state(spark, tmp_path):
    # four files of 10 starts each, 100 s apart; every third span ends 5 s later, others never or too late
    for k in range(5):
        rows = [(i, START + k * 100 + i % 10, False) for i in range(k * 10, k * 10 + 10)] if k < 4 else [(-1, START + 5000, False), (-1, START + 5000, True)]
        rows += [(i, t + (5 if i % 3 == 0 else 50), True) for i, t, _ in rows if i >= 0 and i % 3 < 2]
        df = spark.createDataFrame(rows, "span_id long, at long, ended boolean").select("span_id", F.timestamp_seconds("at").alias("ts"), "ended")
        df.repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = st.stream_table(spark, str(tmp_path / "in"), 1)
    out = st.deadlines(s.where("not ended").select("span_id", "ts"), s.where("ended").select("span_id", "ts"), "20 seconds", "60 seconds")
    got, progress = progress_of(out, tmp_path)
    assert sorted(r[0] for r in got) == [i for i in range(40) if i % 3]
    assert all(r[1:3] == ("ERROR", "POLICY_DEADLINE_EXCEEDED") for r in got)
    batches = {r[0]: r[3] for r in got}
    # the watermark after file k is past the deadlines of file k - 1, so these come out with the next batch
    assert all(len({batches[i] for i in range(k * 10, k * 10 + 10) if i % 3}) == 1 for k in range(4))
    assert sorted(batches.values()) == [batches[i] for i in sorted(batches)] and len(set(batches.values())) == 4
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def plain(rows, ttl, size):
    """The cache by a list of entries and a list of lookups, step by step over all moments."""
    entries, flying, out = [], [], []
    steps = sorted([(t, 1, e, s, None, None) for e, s, t, _, _ in rows] + [(end, 0, e, s, ok, t) for e, s, t, end, ok in rows])
    for t, kind, e, s, ok, _ in steps:
        out += [(x, EXPIRED) for x, w in entries if w + ttl <= t]
        entries = [(x, w) for x, w in entries if w + ttl > t]
        if kind == 0:
            if (s, e) in flying:
                flying.remove((s, e))
                if ok:
                    entries.append((s, t))
                    if len(entries) > size:
                        out.append((entries.pop(0)[0], SIZE))
        elif s in [x for x, _ in entries]:
            out.append((e, HIT))
        else:
            out.append((e, MISS))
            if s in [x for x, _ in flying]:
                out.append((e, COALESCED))
            else:
                flying.append((s, e))
    return sorted(map(str, out + [(x, EXPIRED) for x, _ in entries]))


def requests(seed, n=400, subjects=9):
    rng, t, rows = random.Random(seed), START, []
    for e in range(n):
        t += rng.choice([0, 1, 1, 2, 5]) + (500 if e % 90 == 0 else 0)
        rows.append((e, f"s{min(rng.randrange(subjects), rng.randrange(subjects))}", t, t + rng.randint(1, 12), rng.random() < 0.85))
    return rows


def shown(rows):
    return sorted(str((r.subject, r.cache) if r.event_id is None or pd.isna(r.event_id) else (r.event_id, r.cache)) for r in rows)


def test_the_fold_does_what_a_plain_cache_does():
    for seed in range(20):
        rows, out = requests(seed), []
        cache = CacheFold(60, 3)
        for e, s, t, end, ok in rows:
            cache.ask(s, t, end, e, ok, out)
        cache.settle(10**12, out)
        assert sorted(str((e, c) if e is not None else (s, c)) for s, e, c in out) == plain(rows, 60, 3)
        assert not cache.entries and not cache.flying


def frame(spark, owners):
    rows = [(o, s, e, t, end, ok) for o, rows in owners.items() for e, s, t, end, ok in rows]
    df = spark.createDataFrame(rows, "owner string, subject string, event_id long, t long, end long, ok boolean")
    return df.select("owner", "subject", "event_id", F.timestamp_seconds("t").alias("ts"), F.timestamp_seconds("end").alias("end_ts"), "ok")


def test_batch_and_stream_agree_with_a_plain_cache(spark, tmp_path):
    owners = {"a": requests(1), "b": requests(2), "": requests(3, 50, 2)}
    log = frame(spark, owners)
    report = cache_report(log, "60 seconds", 3).collect()
    st.write_in_order(log, str(tmp_path / "in"), closing="1 day")
    stream = cache_stream(st.stream_table(spark, str(tmp_path / "in"), 2), 60, 3)
    live, progress = progress_of(stream, tmp_path)
    for owner, rows in owners.items():
        want = plain(rows, 60, 3)
        assert shown([r for r in report if r.owner == owner]) == want
        assert sorted(str((s, c) if e is None else (e, c)) for o, s, e, c, _ in live if o == owner) == want
    assert {SIZE, EXPIRED, COALESCED} <= {r.cache for r in report}
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_caches_of_odd_logs(spark):
    log = frame(spark, {"a": [(1, "x", START, START - 5, True), (2, "x", START + 1, START + 2, True), (3, None, START, START, True), (4, "y", START, START + 3, None)]})
    got = shown(cache_report(log, "10 seconds", 1).collect())
    assert got == sorted(["(1, 'MISS')", "(2, 'HIT')", "(4, 'MISS')", "('x', 'EXPIRED')"])
    assert cache_report(log.where("false")).collect() == []


def test_a_state_store_is_the_streams_own(spark):
    before = spark.conf.get(st.PROVIDER)
    with st.state_store(spark, st.ROCKSDB):
        assert spark.conf.get(st.PROVIDER) == st.ROCKSDB
    assert spark.conf.get(st.PROVIDER) == before


def test_a_stopped_stream_goes_on_and_gives_each_event_once(spark, tmp_path):
    rows = [(k % 400, START + k) for k in range(1000)]
    df = spark.createDataFrame(rows, "event_id long, at long").select("event_id", F.timestamp_seconds("at").alias("ts"))
    st.write_in_order(df, str(tmp_path / "in"), steps=5, files=1)
    events = lambda: st.ingest_once(st.stream_table(spark, str(tmp_path / "in"), 1), ["event_id"], "1 day")
    out, check, stops = str(tmp_path / "out"), str(tmp_path / "check"), {1, 3}

    def failing(path):
        put = st.batch_sink(path)

        def sink(batch, number):
            put(batch, number)
            if number in stops:
                stops.discard(number)
                raise RuntimeError("stopped after it was written, before it was committed")

        return sink

    for _ in range(2):
        with pytest.raises(Exception, match="stopped"):
            st.run_batches(events(), "append", st.ROCKSDB, out, check, failing)
    got = st.run_batches(events(), "append", st.ROCKSDB, out, check, failing)
    assert sorted(r.event_id for r in got.collect()) == list(range(400))
    # all batches are committed: another run adds nothing
    assert st.run_batches(events(), "append", st.ROCKSDB, out, check).count() == 400
