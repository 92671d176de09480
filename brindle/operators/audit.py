"""Audit and operations analytics over logs: correlation, pairs, availability, probes, metrics, concurrency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions.tables import saved


def correlate(audit: DataFrame, exchanges: DataFrame, sessions: DataFrame) -> DataFrame:
    """Audit events of measured sessions joined to their exchange by trace and parent span, never by trace alone."""
    e = exchanges.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    e = e.select("session_id", "trace_id", F.col("span_id").alias("parent_span_id"), "exchange_id")
    return audit.join(e, ["trace_id", "parent_span_id"])


def session_counts(correlated: DataFrame) -> DataFrame:
    """(session_id, n_events, n_detected, n_exchanges)."""
    return correlated.groupBy("session_id").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("outcome") == "DETECTED").alias("n_detected"), F.count_distinct("exchange_id").alias("n_exchanges")
    )


def reconcile_pairs(started: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict): OK for one start and one end, else MISSING_TERMINAL, ORPHAN or DUPLICATE."""
    s = started.groupBy(*keys).agg(F.count("*").alias("_s"))
    c = completed.groupBy(*keys).agg(F.count("*").alias("_c"))
    verdict = (
        F.when(F.col("_c").isNull(), "MISSING_TERMINAL").when(F.col("_s").isNull(), "ORPHAN")
        .when((F.col("_s") > 1) | (F.col("_c") > 1), "DUPLICATE").otherwise("OK")
    )
    return s.join(c, keys, "full_outer").select(*keys, verdict.alias("verdict"))


def _grams(text: str, n: int):
    """All runs of n characters of a text, in order; one linear pass."""
    return F.regexp_extract_all(F.col(text), F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))


def gram_index(values: DataFrame, n: int = 6) -> DataFrame:
    """(gram, value) of different values of n characters or more: of each value the gram that the fewest values hold, so that
    what values have in common, such as a prefix, does not bring them together. The first one of equal grams."""
    each = values.where(F.length("value") >= n).select("value", F.posexplode(_grams("value", n)).alias("at", "gram"))
    held = each.select("gram", "value").distinct().groupBy("gram").agg(F.count("*").alias("held"))
    return each.join(held, "gram").groupBy("value").agg(F.min_by("gram", F.struct("held", "at")).alias("gram")).select("gram", "value")


#: Up to so many bytes of values their index is broadcast.
INDEX_BYTES = 4 << 20


def scan_leaks(lines: DataFrame, forbidden: DataFrame, text: str = "line", limit: int = 10_000, n: int = 6) -> DataFrame:
    """Rows of lines that contain a forbidden value (value_id, value), with the value's id (never the value).

    Lines meet different values only: those of n characters or more stand in an index under their rarest gram, which meets the
    different grams of a line in an equi-join without its text; what meets is checked by contains. Shorter values, the empty one
    too, have no gram: they meet each line in arrays of about `limit`, dealt by a hash. Only a hit meets the ids of its value, in
    arrays of about `limit` too. Columns of lines named value or value_id are not allowed. Whatever the number of values, a hit
    is contains(line, value), once for each row of forbidden; null lines and values hit nothing.
    """
    forbidden = forbidden.where("value is not null")
    values = saved(forbidden.groupBy("value").agg(F.count("*").alias("ids")), "values")
    size = values.agg(F.sum(F.when(F.length("value") >= n, F.octet_length("value"))), F.count_if(F.length("value") < n), F.max("ids")).first()
    index = gram_index(values, n)
    index = F.broadcast(index) if (size[0] or 0) <= INDEX_BYTES else index.hint("merge")
    rows = saved(lines.withColumn("_line", F.monotonically_increasing_id()), "lines")
    met = rows.select("_line", F.explode(F.array_distinct(_grams(text, n))).alias("gram")).join(index, "gram").select("_line", "value")
    long = rows.join(met, "_line").where(F.contains(F.col(text), F.col("value"))).drop("_line")
    blocks = max(1, -(-size[1] // limit))
    dealt = values.where(F.length("value") < n).groupBy(F.pmod(F.xxhash64("value"), F.lit(blocks)).alias("_block"))
    short = dealt.agg(F.collect_list("value").alias("_values")).select("_values")
    met = lines.crossJoin(F.broadcast(short) if blocks == 1 else short)
    hits = long.unionByName(met.select(*lines.columns, F.explode(F.filter("_values", lambda v: F.contains(F.col(text), v))).alias("value")))
    parts = max(1, -(-(size[2] or 0) // limit))
    ids = forbidden.groupBy("value", F.pmod(F.xxhash64("value_id"), F.lit(parts)).alias("_part")).agg(F.collect_list(F.struct("value_id")).alias("_ids"))
    hits = hits.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    return hits.join(ids, ["value", "_part"]).select(*lines.columns, F.explode("_ids.value_id").alias("value_id"))


def typed_outcomes(expected: DataFrame, events: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """expected with outcome (NOT_STARTED without an event), coverage (MISSING) and unknown: a code that is not allowed."""
    out = expected.join(events.select(key, "outcome", "coverage", "error_code"), key, "left")
    unknown = F.col("error_code").isNotNull() & ~F.col("error_code").isin(*allowed)
    return out.withColumn("outcome", F.coalesce("outcome", F.lit("NOT_STARTED"))).withColumn("coverage", F.coalesce("coverage", F.lit("MISSING"))).withColumn("unknown", unknown)


def availability_sli(attempts: DataFrame, window: str = "1 day") -> DataFrame:
    """(window_start, n_good, n_bad, n_gap, availability): ALLOW, MASK and BLOCK are good, technical failures bad, client
    faults and cancellations left out, attempts without an end a gap; undefined (null) without attempts."""
    a = attempts.dropDuplicates(["attempt_id"]).groupBy(F.window("ts", window).getField("start").alias("window_start")).agg(
        F.count_if(F.col("outcome").isin("ALLOW", "MASK", "BLOCK")).alias("n_good"),
        F.count_if(F.col("outcome") == "ERROR").alias("n_bad"),
        F.count_if(F.col("outcome").isNull()).alias("n_gap"),
    )
    return a.withColumn("availability", F.try_divide(F.col("n_good"), F.col("n_good") + F.col("n_bad")))


def probe_signals(probes: DataFrame, keys: list[str], run: int = 3) -> DataFrame:
    """The probe at which `run` failures in a row are reached; a 200 starts anew."""
    w = W.partitionBy(*keys).orderBy("ts", "probe_id")
    p = probes.withColumn("_island", F.sum((F.col("status") == 200).cast("int")).over(w)).where("status <> 200")
    p = p.withColumn("_k", F.row_number().over(W.partitionBy(*keys, "_island").orderBy("ts", "probe_id")))
    return p.where(F.col("_k") == run).drop("_island", "_k")


#: Upper bounds of the latency histogram, in ms (fixed values).
BUCKETS = (5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)


def exchange_metrics(exchanges: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """(window_start, status_class, n, n_timeouts, n_cancelled, total_ms, histogram): metrics of completed exchanges."""
    place = F.size(F.filter(F.array(*map(F.lit, BUCKETS)), lambda b: b < F.col("duration_ms")))
    e = exchanges.select(F.window("ts", bucket).getField("start").alias("window_start"), F.floor(F.col("status") / 100).cast("int").alias("status_class"), "failure", "duration_ms", place.alias("_b"))
    counts = [F.count_if(F.col("_b") == k) for k in range(len(BUCKETS) + 1)]
    return e.groupBy("window_start", "status_class").agg(
        F.count("*").alias("n"), F.count_if(F.col("failure") == "TIMEOUT").alias("n_timeouts"),
        F.count_if(F.col("failure") == "CANCELLATION").alias("n_cancelled"), F.sum("duration_ms").alias("total_ms"), F.array(*counts).alias("histogram"),
    )


def classify_failure(cause):
    """TIMEOUT, CANCELLATION or TRANSPORT of an exception's class name; null without one."""
    return F.when(cause.rlike("(?i)timeout|timedout"), "TIMEOUT").when(cause.rlike("(?i)cancel|abort|closedsession"), "CANCELLATION").when(cause.isNotNull(), "TRANSPORT")


def identity_cache_report(log: DataFrame, ttl: str = "5 minutes") -> DataFrame:
    """log (subject, ts, event_id, ok) with cache: HIT if the last successful lookup that was written is younger than
    the TTL, MISS otherwise; failures are not cached. A miss that succeeds writes; hits do not prolong.

    A gap of a TTL or more empties the cache for certain, so it cuts a subject's time line into spells that are dealt on
    their own. A spell is a fold over its rows in order that carries the last write only; no rows are held.
    """
    spark = log.sparkSession
    micros = spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {ttl}) AS t").first().t
    own = W.partitionBy("subject").orderBy("ts", "event_id")
    at = F.unix_micros("ts")
    rows = log.select("subject", at.alias("at"), "event_id", "ok", (at - F.lag(at).over(own) >= micros).cast("int").alias("_new"), "ts")
    rows = rows.withColumn("spell", F.sum(F.coalesce("_new", F.lit(0))).over(own)).select("subject", "spell", "at", "event_id", "ok")
    order = ["subject", "spell", "at", "event_id"]

    def fold(batches):
        spell, write = None, None
        for pdf in batches:
            hits = []
            for row in zip(pdf["subject"], pdf["spell"], pdf["at"], pdf["ok"], strict=True):
                if row[:2] != spell:
                    spell, write = row[:2], None
                hit = write is not None and row[2] < write + micros
                if not hit and row[3]:
                    write = row[2]
                hits.append("HIT" if hit else "MISS")
            yield pdf[["subject", "event_id"]].assign(cache=hits)

    kinds = f"subject {log.schema['subject'].dataType.simpleString()}, event_id {log.schema['event_id'].dataType.simpleString()}, cache string"
    return rows.repartition("subject", "spell").sortWithinPartitions(*order).mapInPandas(fold, kinds)


def concurrency_profile(exchanges: DataFrame, keys: list[str], owners: int = 128, size: int = 64 << 20, span: str = "1 hour") -> DataFrame:
    """(keys, ts, active, retained, over): running number of open exchanges and of their bytes at each change, ends
    before starts; over where a limit is passed.

    Changes are summed by spans of time first and the sums added up over a key's spans; inside a span the running sum
    starts from there. So a key's changes are dealt to as many groups as it has spans.
    """
    start = exchanges.select(*keys, F.col("start_ts").alias("ts"), F.lit(1).alias("_d"), F.col("bytes").alias("_b"))
    end = exchanges.select(*keys, F.col("end_ts").alias("ts"), F.lit(-1).alias("_d"), (-F.col("bytes")).alias("_b"))
    at = start.union(end).groupBy(*keys, "ts").agg(F.sum("_d").alias("_d"), F.sum("_b").alias("_b"))
    at = at.withColumn("_span", F.window("ts", span).getField("start"))
    before = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    sums = at.groupBy(*keys, "_span").agg(F.sum("_d").alias("_d"), F.sum("_b").alias("_b"))
    base = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("_d", "_d0"), ("_b", "_b0"))]
    at = at.join(sums.select(*keys, "_span", *base), [*keys, "_span"])
    w = W.partitionBy(*keys, "_span").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    out = at.withColumn("active", F.col("_d0") + F.sum("_d").over(w)).withColumn("retained", F.col("_b0") + F.sum("_b").over(w))
    out = out.drop("_d", "_b", "_d0", "_b0", "_span")
    return out.withColumn("over", (F.col("active") > owners) | (F.col("retained") > size))


def compare_matrix(expected: DataFrame, observed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, verdict, mismatches): SAME, DIFFERENT with the differing columns, MISSING or UNEXPECTED."""
    e, o = expected.alias("e"), observed.alias("o")
    j = e.join(o, F.col(f"e.{key}") == F.col(f"o.{key}"), "full_outer")
    bad = F.array_compact(F.array(*[F.when(~F.col(f"e.{c}").eqNullSafe(F.col(f"o.{c}")), F.lit(c)) for c in columns]))
    verdict = F.when(F.col(f"o.{key}").isNull(), "MISSING").when(F.col(f"e.{key}").isNull(), "UNEXPECTED").when(F.size(bad) > 0, "DIFFERENT").otherwise("SAME")
    return j.select(F.coalesce(f"e.{key}", f"o.{key}").alias(key), verdict.alias("verdict"), F.when(verdict == "DIFFERENT", F.array_join(bad, ",")).alias("mismatches"))
