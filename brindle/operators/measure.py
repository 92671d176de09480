"""Measurement analytics: percentiles, overheads, windows, memory trends, regressions and test totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions.tables import saved

MIB = 1 << 20


def ranked_percentiles(samples: DataFrame, by: list[str], value: str, points: tuple[float, ...], ranges: int = 64) -> DataFrame:
    """(by, p<100 * point> ...): exact percentiles by nearest rank, nulls left out, without holding a group's values.

    Equal values are counted first. The counts are summed by ranges of values (cut at approximate quantiles of all), the
    sums added up over a group's ranges, and inside a range the running count starts from there; so a group is dealt to
    `ranges` parts, however many samples it has.
    """
    known = samples.where(F.col(value).isNotNull())
    return _ranked(known.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n")), by, points, _cuts(known, value, ranges))


def _cuts(df: DataFrame, value: str, ranges: int) -> list[float]:
    return sorted(set(df.approxQuantile(value, [k / ranges for k in range(1, ranges)], 0.005)))


def _ranked(c: DataFrame, by: list[str], points: tuple[float, ...], cuts: list[float]) -> DataFrame:
    """ranked_percentiles of values (_v) that are counted (_n) already."""
    c = c.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col("_v"))) if cuts else F.lit(0))
    sums = c.groupBy(*by, "_range").agg(F.sum("_n").alias("_s"))
    own = W.partitionBy(*by)
    sums = sums.withColumn("_all", F.sum("_s").over(own)).withColumn("_before", F.coalesce(F.sum("_s").over(own.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*by, "_range"]]
    j = c.alias("c").join(sums.alias("s"), same).select(*[F.col(f"c.{k}").alias(k) for k in [*by, "_range"]], "_v", "_n", "_all", "_before")
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*by, "_range").orderBy("_v"))
    j = j.withColumn("_upto", upto)
    return j.groupBy(*by).agg(*[F.min(F.when(F.col("_upto") >= p * F.col("_all"), F.col("_v"))).alias(f"p{int(p * 100)}") for p in points])


def latency_percentiles(samples: DataFrame, by: list[str], value: str = "value", exact: bool = True) -> DataFrame:
    """(by, n, p50, p95, p99, max) by nearest rank for each group and each prefix of the groups, the rest of by null.

    Equal values of a group are counted once, in a table; every prefix adds up those counts, and all use the same ranges of
    values. exact=False takes the approximate percentile in one rollup.
    """
    points = (0.5, 0.95, 0.99)
    if not exact:
        return samples.rollup(*by).agg(F.count("*").alias("n"), *[F.percentile_approx(value, p, 10_000).alias(f"p{int(p * 100)}") for p in points], F.max(value).alias("max"))
    counts = saved(samples.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n")), "counts")
    cuts = _cuts(counts.where("_v is not null"), "_v", 64)
    kinds = {f.name: f.dataType for f in samples.schema}
    out = None
    for k in range(len(by), -1, -1):
        keys = by[:k]
        level = counts if k == len(by) else counts.groupBy(*keys, "_v").agg(F.sum("_n").alias("_n"))
        n = level.groupBy(*keys).agg(F.sum("_n").alias("n"), F.max("_v").alias("max"))
        p = _ranked(level.where("_v is not null"), keys, points, cuts)
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"p.{c}")) for c in keys] or F.lit(True)
        level = n.alias("n").join(p.alias("p"), same, "left").select(
            *[F.col(f"n.{c}").alias(c) if c in keys else F.lit(None).cast(kinds[c]).alias(c) for c in by], F.coalesce("n", F.lit(0)).alias("n"), "p50", "p95", "p99", "max"
        )
        out = level if out is None else out.union(level)
    return out


def overhead(percentiles: DataFrame, profile: str, limit: float, least: int) -> DataFrame:
    """(profile, direct_p99, proxy_p99, overhead, verdict): PASS, DEVIATION, or SMOKE ONLY below `least` samples."""
    route = lambda r, c: F.max(F.when(F.col("route") == r, F.col(c)))
    out = percentiles.groupBy(profile).agg(
        route("direct", "p99").alias("direct_p99"), route("proxy", "p99").alias("proxy_p99"),
        F.least(route("direct", "n"), route("proxy", "n")).alias("n"),
    )
    out = out.withColumn("overhead", F.col("proxy_p99") - F.col("direct_p99"))
    return out.withColumn("verdict", F.when(F.col("n") < least, "SMOKE ONLY").when(F.col("overhead") <= limit, "PASS").otherwise("DEVIATION"))


def delivery(expected: DataFrame, observed: DataFrame, key: str, least: float = 0.99) -> DataFrame:
    """(key, n_expected, n_observed, ratio, passed, lost)."""
    o = observed.groupBy(key).agg(F.count("*").alias("n_observed"))
    out = expected.join(o, key, "left").na.fill(0, ["n_observed"]).withColumn("ratio", F.try_divide("n_observed", "n_expected"))
    return out.withColumn("passed", F.coalesce(F.col("ratio") >= least, F.lit(False))).withColumn("lost", F.col("n_expected") - F.col("n_observed"))


def measurement_window(samples: DataFrame, key: str) -> DataFrame:
    """(key, from_ts, to_ts): the half-open window of a route's samples (start_ts, end_ts)."""
    return samples.groupBy(key).agg(F.min("start_ts").alias("from_ts"), F.max("end_ts").alias("to_ts"))


def events_in_windows(events: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Events whose start lies in their key's window; events (key, ts, ...) x windows (key, from_ts, to_ts)."""
    return events.join(windows, key).where((F.col("ts") >= F.col("from_ts")) & (F.col("ts") < F.col("to_ts")))


def forbidden_frames(events: DataFrame, key: str, prefixes: list[str], most: int = 20) -> DataFrame:
    """The first `most` events of each key with a stack frame of a forbidden prefix, and how many there are in all."""
    bad = events.where(F.exists("frames", lambda f: F.array_max(F.transform(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(f, p)))))
    n = bad.groupBy(key).agg(F.count("*").alias("n_bad"))
    # first in parts of each key, so that no task orders all events of one
    part = F.pmod(F.xxhash64("event_id"), F.lit(64))
    for w in (W.partitionBy(key, part), W.partitionBy(key)):
        bad = bad.withColumn("_k", F.row_number().over(w.orderBy("ts", "event_id"))).where(F.col("_k") <= most).drop("_k")
    return bad.join(n, key)


def memory_trend(samples: DataFrame, key: str, edge: int = 10, allowance: int = 64 * MIB) -> DataFrame:
    """(key, head, tail, bounded): lower medians of the first and last samples; bounded if the tail is within the allowance."""
    up, down = (F.row_number().over(W.partitionBy(key).orderBy(o, o2)) for o, o2 in ((F.asc("ts"), F.asc("sample_id")), (F.desc("ts"), F.desc("sample_id"))))
    s = samples.withColumn("_u", up).withColumn("_d", down).where((F.col("_u") <= edge) | (F.col("_d") <= edge))
    med = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN {c} <= {edge} THEN value END)")
    out = s.groupBy(key).agg(med("_u").alias("head"), med("_d").alias("tail"))
    return out.withColumn("bounded", F.col("tail") <= F.col("head") + allowance)


def plateau(samples: DataFrame, key: str, run: int = 5, spread: int = 16 * MIB) -> DataFrame:
    """samples with reached (the last `run` values lie within the spread) and high_water, the largest value so far."""
    w = W.partitionBy(key).orderBy("ts", "sample_id")
    last = w.rowsBetween(-(run - 1), 0)
    enough = F.count("*").over(last) == run
    reached = enough & (F.max("value").over(last) - F.min("value").over(last) <= spread)
    return samples.withColumn("reached", reached).withColumn("high_water", F.max("value").over(w.rowsBetween(W.unboundedPreceding, 0)))


def terminal_memory(samples: DataFrame, key: str, allowance: int = 64 * MIB) -> DataFrame:
    """(key, first, last, within): whether the last sample is within the allowance of the first."""
    out = samples.groupBy(key).agg(F.min_by("value", F.struct("ts", "sample_id")).alias("first"), F.max_by("value", F.struct("ts", "sample_id")).alias("last"))
    return out.withColumn("within", F.col("last") <= F.col("first") + allowance)


def paired_regression(current: DataFrame, baseline: DataFrame, case: list[str], scenario: str, columns: tuple[str, ...] = ("p50", "p95", "p99"), limit: float = 0.10) -> DataFrame:
    """(scenario, n, median change of each column, passed) of the paired cases current / baseline - 1."""
    b = baseline.select(*case, *[F.col(c).alias(f"b_{c}") for c in columns])
    j = current.join(b, case)
    for c in columns:
        j = j.withColumn(f"d_{c}", F.try_divide(c, f"b_{c}") - 1)
    out = j.groupBy(scenario).agg(F.count("*").alias("n"), *[F.median(f"d_{c}").alias(f"d_{c}") for c in columns])
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.col(f"d_{c}") <= limit, F.lit(False))
    return out.withColumn("passed", ok)


def same_environment(a: DataFrame, b: DataFrame, ignore: tuple[str, ...], key: str) -> DataFrame:
    """(key, same): whether the property maps (key, env) of two runs are equal but for the keys ignored; a run that is
    missing on one side differs."""
    known = F.map_entries(F.map_filter("env", lambda k, v: ~k.isin(*ignore))) if ignore else F.map_entries("env")
    x, y = (d.select(key, F.array_sort(known).alias(n)) for d, n in ((a, "_a"), (b, "_b")))
    return x.join(y, key, "full_outer").select(key, F.col("_a").eqNullSafe(F.col("_b")).alias("same"))


def test_totals(cases: DataFrame) -> DataFrame:
    """(task, class, n, n_failed, seconds) of each class, each task and the suite, slowest first."""
    out = cases.rollup("task", "class").agg(F.count("*").alias("n"), F.count_if("failed").alias("n_failed"), F.sum("seconds").alias("seconds"))
    return out.orderBy(F.desc("seconds"), "task", "class")


def throughput_verdict(runs: DataFrame, most: float = 0.70, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ratio, passed, reasons) of runs (by, phase, seconds, failed): the median after over the median before."""
    by = list(by)
    med = lambda p: F.max(F.when(F.col("phase") == p, F.col("p50")))
    medians = ranked_percentiles(runs, [*by, "phase"], "seconds", (0.5,)).groupBy(*by).agg(med("before").alias("_b"), med("after").alias("_a"))
    out = runs.groupBy(*by).agg(F.count_if("failed").alias("_f"), F.count_if(F.col("phase") == "before").alias("_nb"), F.count_if(F.col("phase") == "after").alias("_na"))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by] or F.lit(True)
    out = out.alias("o").join(medians.alias("m"), same, "left").select(*[F.col(f"o.{c}").alias(c) for c in by], "_f", "_nb", "_na", F.try_divide("_a", "_b").alias("ratio"))
    reasons = F.array_compact(F.array(
        F.when(F.col("_f") > 0, "FAILED_RUN"), F.when((F.col("_nb") < 3) | (F.col("_na") < 3), "TOO_FEW_RUNS"), F.when(F.col("ratio") > most, "TOO_SLOW")
    ))
    return out.select(*by, "ratio", (F.size(reasons) == 0).alias("passed"), F.array_join(reasons, ",").alias("reasons"))


def matrix_problems(observed: DataFrame, dims: list[DataFrame]) -> DataFrame:
    """(dims, problem): cells of the product of dimensions (that is what the matrix is; its rows are the result's bound) that were not observed (MISSING) or twice (DUPLICATE)."""
    cells = dims[0]
    for d in dims[1:]:
        cells = cells.crossJoin(d)
    keys = cells.columns
    missing = cells.join(observed, keys, "left_anti").withColumn("problem", F.lit("MISSING"))
    twice = observed.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("DUPLICATE").alias("problem"))
    return missing.union(twice)
