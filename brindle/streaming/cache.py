"""A cache of identities with a life time and a largest size, as a fold over a log and as a stream with timers."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What is reported: a request finds its entry, does not, or joins a lookup under way; an entry leaves by age or for size.
HIT, MISS, COALESCED, EXPIRED, SIZE = "HIT", "MISS", "COALESCED", "EXPIRED", "SIZE"
FOREVER = 1 << 62


class CacheFold:
    """One cache in the order of time. Times are microseconds.

    A miss starts a lookup, which lands at its end; requests for the same subject until then join it. A lookup that
    succeeds writes an entry, which lives for `ttl`; a write beyond `size` entries pushes out the oldest one. Failures are not
    kept and hits do not prolong. At one moment entries expire first, then lookups land, then requests come.
    """

    def __init__(self, ttl: int, size: int, entries: list[tuple] = (), flying: list[tuple] = ()):
        self.ttl, self.size = ttl, size
        self.entries = dict(entries)  # subject -> time of the write, in the order of writes
        self.flying = {s: (end, event_id, ok) for s, end, event_id, ok in flying}
        self.landings = [(end, event_id, s) for s, end, event_id, _ in flying]
        heapq.heapify(self.landings)

    def _expire(self, now: int, out: list) -> None:
        while self.entries:
            subject, written = next(iter(self.entries.items()))
            if written + self.ttl > now:
                return
            del self.entries[subject]
            out.append((subject, None, EXPIRED))

    def settle(self, now: int, out: list) -> None:
        """All that happens up to a moment without a request."""
        while self.landings and self.landings[0][0] <= now:
            end, _, subject = heapq.heappop(self.landings)
            ok = self.flying.pop(subject)[2]
            self._expire(end, out)
            if ok:
                self.entries[subject] = end
                if len(self.entries) > self.size:
                    oldest = next(iter(self.entries))
                    del self.entries[oldest]
                    out.append((oldest, None, SIZE))
        self._expire(now, out)

    def ask(self, subject, at: int, end: int, event_id: int, ok: bool, out: list) -> None:
        self.settle(at, out)
        if subject in self.entries:
            out.append((subject, event_id, HIT))
            return
        out.append((subject, event_id, MISS))
        if subject in self.flying:
            out.append((subject, event_id, COALESCED))
            return
        self.flying[subject] = (end, event_id, ok)
        heapq.heappush(self.landings, (end, event_id, subject))

    def next_change(self) -> int | None:
        """When something happens without a request; None if nothing will."""
        times = [self.landings[0][0]] if self.landings else []
        if self.entries:
            times.append(next(iter(self.entries.values())) + self.ttl)
        return min(times, default=None)


def cache_report(log: DataFrame, ttl: str = "5 minutes", size: int = 10_000) -> DataFrame:
    """(owner, subject, event_id, cache) of a log (owner, subject, event_id long, ts, end_ts, ok): what each cache did.

    A request is HIT or MISS, and COALESCED beside MISS if it joined a lookup; an entry that leaves is EXPIRED or SIZE, without
    event_id. See CacheFold; rows of one moment come by event_id. A time in which all entries and lookups of a cache have
    passed cuts its log into spells, which are folded on their own; a spell is one task's work and holds `size` entries at
    most. Rows without owner, subject, ts or end_ts are left out; an empty log gives no rows.
    """
    spark = log.sparkSession
    life = spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {ttl}) AS t").first().t
    own = W.partitionBy("owner").orderBy("at", "event_id")
    rows = log.dropna(subset=["owner", "subject", "ts", "end_ts"]).select(
        "owner", "subject", "event_id", F.unix_micros("ts").alias("at"), F.greatest(F.unix_micros("end_ts"), F.unix_micros("ts")).alias("end"), F.coalesce("ok", F.lit(False)).alias("ok")
    )
    quiet = F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1)) + life <= F.col("at")
    rows = rows.withColumn("spell", F.sum(F.coalesce(quiet, F.lit(False)).cast("int")).over(own))

    def fold(batches):
        spell, cache = None, None
        for pdf in batches:
            out, owners = [], []
            for owner, subject, event_id, at, end, ok, k in zip(*(pdf[c] for c in ("owner", "subject", "event_id", "at", "end", "ok", "spell")), strict=True):
                if (owner, k) != spell:
                    if cache:
                        cache.settle(FOREVER, out)
                        owners += [spell[0]] * (len(out) - len(owners))
                    spell, cache = (owner, k), CacheFold(life, size)
                cache.ask(subject, at, end, event_id, ok, out)
                owners += [owner] * (len(out) - len(owners))
            yield _frame(owners, out)
        if cache:
            cache.settle(FOREVER, out := [])
            yield _frame([spell[0]] * len(out), out)

    kinds = [log.schema[c].dataType.simpleString() for c in ("owner", "subject")]
    ordered = rows.repartition("owner", "spell").sortWithinPartitions("owner", "spell", "at", "event_id")
    return ordered.mapInPandas(fold, f"owner {kinds[0]}, subject {kinds[1]}, event_id long, cache string")


def _frame(owners: list, out: list) -> pd.DataFrame:
    pdf = pd.DataFrame(out, columns=["subject", "event_id", "cache"])
    pdf["event_id"] = pdf["event_id"].astype("Int64")
    pdf.insert(0, "owner", owners)
    return pdf


class CacheProcessor(StatefulProcessor):
    """CacheFold over a stream: entries and lookups under way are map states, a timer stands at the next change."""

    def __init__(self, ttl: int, size: int, kind: str):
        self.ttl, self.size, self.kind = ttl, size, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", f"subject {self.kind}", "written long, place int")
        self.flying = handle.getMapState("flying", f"subject {self.kind}", "end long, event_id long, ok boolean")

    def _load(self) -> CacheFold:
        entries = sorted((v[0], v[1], k[0]) for k, v in self.entries.iterator()) if self.entries.exists() else []
        flying = [(k[0], *v) for k, v in self.flying.iterator()] if self.flying.exists() else []
        return CacheFold(self.ttl, self.size, [(s, t) for t, _, s in entries], flying)

    def _store(self, cache: CacheFold) -> None:
        for state, now in ((self.entries, {s: (t, k) for k, (s, t) in enumerate(cache.entries.items())}), (self.flying, cache.flying)):
            state.clear()
            for subject, value in now.items():
                state.updateValue((subject,), value)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        change = cache.next_change()
        if change is not None:
            self.handle.registerTimer(-(-change // 1000))

    def handleInputRows(self, key, rows, timerValues):
        cache, out = self._load(), []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            at = r.ts.value // 1000
            cache.ask(r.subject, at, max(at, r.end_ts.value // 1000), r.event_id, bool(r.ok), out)
        self._store(cache)
        yield _frame([key[0]] * len(out), out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        cache, out = self._load(), []
        cache.settle(timerValues.getCurrentWatermarkInMs() * 1000, out)
        self._store(cache)
        yield _frame([key[0]] * len(out), out)

    def close(self) -> None:
        pass


def cache_stream(log: DataFrame, ttl_seconds: int = 300, size: int = 10_000, late: str = "1 second") -> DataFrame:
    """As cache_report for a stream whose batches come in the order of time; it needs RocksDB as state store.

    Requests are answered in the batch that brings them, entries leave in the batch whose watermark passes their time. State
    is `size` entries a cache at most.
    """
    kinds = [log.schema[c].dataType.simpleString() for c in ("owner", "subject")]
    rows = log.withWatermark("ts", late).dropna(subset=["owner", "subject", "ts", "end_ts"]).select("owner", "subject", "event_id", "ts", "end_ts", F.coalesce("ok", F.lit(False)).alias("ok"))
    return rows.groupBy("owner").transformWithStateInPandas(
        CacheProcessor(ttl_seconds * 1_000_000, size, kinds[1]), f"owner {kinds[0]}, subject {kinds[1]}, event_id long, cache string", "append", "EventTime"
    )
