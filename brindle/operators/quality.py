"""Evaluation of predicted spans against gold spans: matches, scores, gates and comparisons."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions.tables import saved


def exact_counts(gold: DataFrame, pred: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, type, n_gold, n_pred, tp): one-to-one matches of equal type, start and end."""
    key = [case, "type", "start", "end"]
    g = gold.groupBy(*key).agg(F.count("*").alias("g"))
    p = pred.groupBy(*key).agg(F.count("*").alias("p"))
    j = g.join(p, key, "full_outer").na.fill(0, ["g", "p"])
    return j.groupBy(case, "type").agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"), F.sum(F.least("g", "p")).alias("tp"))


def overlap_pairs(gold: DataFrame, pred: DataFrame, keys: list[str], bin_size: int | None = None) -> DataFrame:
    """Pairs of spans of equal keys that overlap: (keys, g_id, p_id, g_start, g_end, p_start, p_end).

    With bin_size, spans meet in bins of their range, so that one huge key is no single group; a pair is kept in the
    bin where its overlap begins.
    """
    g = gold.select(*keys, F.col("span_id").alias("g_id"), F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    p = pred.select(*keys, F.col("span_id").alias("p_id"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    on = list(keys)
    if bin_size:
        bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor((F.col(b) - 1) / bin_size)))
        g, p, on = g.withColumn("_bin", bins("g_start", "g_end")), p.withColumn("_bin", bins("p_start", "p_end")), [*keys, "_bin"]
    j = g.join(p, on).where((F.col("g_start") < F.col("p_end")) & (F.col("p_start") < F.col("g_end")))
    if bin_size:
        j = j.where(F.floor(F.greatest("g_start", "p_start") / bin_size) == F.col("_bin")).drop("_bin")
    return j


def _sweep(batches):
    """Matches of spans that come sorted by case, type and start, each key's in one piece.

    Of the spans that wait for a partner the one that ends first takes, when its end is passed, the waiting span of the
    other side that ends first: both reach over that end, and what else the taken span could meet, later ones meet too,
    so the matching is a largest one. Only waiting spans are held.
    """
    key, waiting = None, ([], [])

    def settle(until=None):
        while waiting[0] or waiting[1]:
            side = 0 if not waiting[1] or (waiting[0] and waiting[0][0] <= waiting[1][0]) else 1
            if until is not None and waiting[side][0][0] > until:
                return
            x = heapq.heappop(waiting[side])
            if waiting[1 - side]:
                y = heapq.heappop(waiting[1 - side])
                yield (*key, x[2], y[2]) if side == 0 else (*key, y[2], x[2])

    for pdf in batches:
        out = []
        for case, kind, start, end, side, span in zip(*(pdf[c].tolist() for c in ("case_id", "type", "start", "end", "side", "span_id")), strict=True):
            if (case, kind) != key:
                out += settle()
                key = (case, kind)
            else:
                out += settle(start)
            heapq.heappush(waiting[side], (end, start, span))
        yield pd.DataFrame(out, columns=["case_id", "type", "g_id", "p_id"])
    yield pd.DataFrame(list(settle()), columns=["case_id", "type", "g_id", "p_id"])


def match_spans(gold: DataFrame, pred: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, type, g_id, p_id): a largest one-to-one matching of overlapping spans of one type.

    One shuffle by case and type and one ordered pass; empty spans and rows of null case or type match nothing.
    """
    both = gold.select(F.col(case).alias("case_id"), "type", "start", "end", "span_id", F.lit(0).alias("side")).union(
        pred.select(F.col(case).alias("case_id"), "type", "start", "end", "span_id", F.lit(1).alias("side"))
    )
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    schema = f"case_id {kinds['case_id']}, type {kinds['type']}, g_id {kinds['span_id']}, p_id {kinds['span_id']}"
    both = both.where("start < end and case_id is not null and type is not null").repartition("case_id", "type")
    found = both.sortWithinPartitions("case_id", "type", "start", "end", "side", "span_id").mapInPandas(_sweep, schema)
    return found.withColumnRenamed("case_id", case)


def relaxed_counts(gold: DataFrame, pred: DataFrame, case: str = "case_id") -> DataFrame:
    """As exact_counts, for the largest matching of overlapping spans."""
    tp = match_spans(gold, pred, case).groupBy(case, "type").agg(F.count("*").alias("tp"))
    g = gold.groupBy(case, "type").agg(F.count("*").alias("n_gold"))
    p = pred.groupBy(case, "type").agg(F.count("*").alias("n_pred"))
    return g.join(p, [case, "type"], "full_outer").join(tp, [case, "type"], "left").na.fill(0, ["n_gold", "n_pred", "tp"])


def ratios(tp: Column, n_pred: Column, n_gold: Column, empty: float | None = 0.0) -> list[Column]:
    """precision, recall and f1; an empty denominator gives 0.0 in the canonical convention, null in the other."""
    p, r = F.try_divide(tp, n_pred), F.try_divide(tp, n_gold)
    f = F.try_divide(2 * tp, n_pred + n_gold)
    return [(F.coalesce(x, F.lit(empty)) if empty is not None else x).alias(n) for x, n in ((p, "precision"), (r, "recall"), (f, "f1"))]


def score(counts: DataFrame, by: list[str] | None = None, empty: float | None = 0.0) -> DataFrame:
    """(by, type, tp, fp, fn, precision, recall, f1) of each type and, type null, of all together (sums first)."""
    by = by or []
    sums = counts.groupBy(*by, "type").agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_gold").alias("n_gold"))
    total = sums.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_gold").alias("n_gold"))
    both = sums.unionByName(total.withColumn("type", F.lit(None).cast("string")))
    tp, p, g = F.col("tp"), F.col("n_pred"), F.col("n_gold")
    return both.select(*by, "type", "tp", (p - tp).alias("fp"), (g - tp).alias("fn"), *ratios(tp, p, g, empty))


def canonical_gate(cases: DataFrame, minimum: int = 100) -> DataFrame:
    """(type, category, n_cases, n_equal, passed) of cases (type, category, expected, actual): all findings equal,
    order and metadata included, negatives empty, enough cases."""
    same = F.when(F.col("category") == "NEGATIVE", F.size("actual") == 0).otherwise(F.col("expected").eqNullSafe(F.col("actual")))
    out = cases.groupBy("type", "category").agg(F.count("*").alias("n_cases"), F.count_if(same).alias("n_equal"))
    return out.withColumn("passed", (F.col("n_cases") == F.col("n_equal")) & (F.col("n_cases") >= minimum))


def frozen_split(case_id: Column, salt: str, revision: str) -> Column:
    """evaluation for the first quarter of the first byte of SHA-256(salt, revision, case), else tuning."""
    digest = F.sha2(F.concat_ws("\u0000", F.lit(salt), F.lit(revision), case_id.cast("string")), 256)
    return F.when(F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") < 64, "evaluation").otherwise("tuning")


def gold_views(source: DataFrame, product: DataFrame, nested: DataFrame) -> DataFrame:
    """The three gold tables as one, with a view column, so that one pass scores all."""
    views = [d.withColumn("view", F.lit(n)) for n, d in (("source", source), ("product", product), ("nested_ip", nested))]
    return views[0].unionByName(views[1]).unionByName(views[2])


def product_gold(gold: DataFrame, case: str = "case_id", gap: int = 32) -> tuple[DataFrame, DataFrame]:
    """(gold, adjustments): ten-digit INNs of companies dropped; passport parts of four and six digits that stand close
    and in order merged, each part once; and how often each rule (with its version) was used.

    gold (case_id, type, start, end, value, gap_text): gap_text is the text up to the next span of the case.
    """
    company = (F.col("type") == "RU_INN") & F.col("value").rlike(r"\A[0-9]{10}\z")
    w = W.partitionBy(case).orderBy("start", "end")
    kept = gold.where(~company).withColumn("_next", F.lead(F.struct("type", "start", "end", "value")).over(w))
    words = r"\A(?:[\s\p{P}№]|серия|номер|выдан|паспорт){0,%d}\z" % gap
    pair = (
        (F.col("type") == "RU_PASSPORT") & (F.col("_next.type") == "RU_PASSPORT") & F.col("value").rlike(r"\A[0-9]{2} ?[0-9]{2}\z")
        & F.col("_next.value").rlike(r"\A[0-9]{6}\z") & (F.length("gap_text") <= gap) & F.lower("gap_text").rlike(words)
    )
    kept = kept.withColumn("_pair", F.coalesce(pair, F.lit(False)))
    kept = kept.withColumn("_second", F.coalesce(F.lag("_pair").over(w), F.lit(False)))
    out = kept.where(~F.col("_second")).withColumn("end", F.when(F.col("_pair"), F.col("_next.end")).otherwise(F.col("end")))
    dim = gold.sparkSession.createDataFrame([("LEGAL_ENTITY_INN", 1), ("PASSPORT_PARTS", 1)], "rule string, version int")
    used = gold.where(company).select(F.lit("LEGAL_ENTITY_INN").alias("rule")).union(kept.where("_pair").select(F.lit("PASSPORT_PARTS")))
    counts = used.groupBy("rule").agg(F.count("*").alias("n"))
    return out.drop("_next", "_pair", "_second"), dim.join(counts, "rule", "left").na.fill(0, ["n"])


def mismatches(gold: DataFrame, pred: DataFrame, matched: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, type, side, bucket): NO_OVERLAPPING_FINDING, SPAN_MISMATCH or TYPE_MISMATCH of unmatched gold spans,
    EXTRA_PREDICTION of unmatched predictions."""
    lost = gold.join(matched.select(case, F.col("g_id").alias("span_id")), [case, "span_id"], "left_anti")
    extra = pred.join(matched.select(case, F.col("p_id").alias("span_id")), [case, "span_id"], "left_anti")
    g, p = lost.alias("g"), pred.alias("p")
    near = (F.col(f"g.{case}") == F.col(f"p.{case}")) & (F.col("g.start") < F.col("p.end")) & (F.col("p.start") < F.col("g.end"))
    same = F.bool_or(F.col("p.type") == F.col("g.type"))
    bucket = F.when(F.count("p.span_id") == 0, "NO_OVERLAPPING_FINDING").when(same, "SPAN_MISMATCH").otherwise("TYPE_MISMATCH")
    rows = g.join(p, near, "left").groupBy(F.col(f"g.{case}").alias(case), F.col("g.span_id").alias("span_id"), F.col("g.type").alias("type")).agg(bucket.alias("bucket"))
    return rows.select(case, "type", F.lit("gold").alias("side"), "bucket").union(extra.select(case, "type", F.lit("pred"), F.lit("EXTRA_PREDICTION")))


def evidence_contributions(pred: DataFrame, matched: DataFrame, case: str = "case_id") -> DataFrame:
    """(type, evidence, n, n_matched, n_false) with totals by type and by evidence (cube)."""
    m = matched.select(case, F.col("p_id").alias("span_id")).withColumn("_hit", F.lit(1))
    j = pred.join(m, [case, "span_id"], "left")
    return j.cube("type", "evidence").agg(F.count("*").alias("n"), F.count("_hit").alias("n_matched"), F.count_if(F.col("_hit").isNull()).alias("n_false"))


def coverage_report(cases: DataFrame, spans: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, mapped, n_spans, n_cases, n_rejected, n_clean): spans of every label of the dimension, zero included."""
    totals = cases.agg(F.count("*").alias("n_cases"), F.count_if(F.col("reject").isNotNull()).alias("n_rejected"), F.count_if(F.col("n_entities") == 0).alias("n_clean"))
    n = spans.groupBy("label").agg(F.count("*").alias("n_spans"))
    return labels.join(n, "label", "left").na.fill(0, ["n_spans"]).crossJoin(F.broadcast(totals))


def coverage_gate(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """Rows that only one of two tables of counts has; none if the observed coverage is the declared one."""
    a = observed.exceptAll(declared).withColumn("side", F.lit("observed"))
    return a.union(declared.exceptAll(observed).withColumn("side", F.lit("declared")))


def document_fpr(cases: DataFrame) -> DataFrame:
    """(n_clean, n_flagged, fpr) on cases without gold entities; null if there is none."""
    n, k = F.count("*"), F.count_if(F.col("n_pred") > 0)
    return cases.where("n_entities = 0").agg(n.alias("n_clean"), k.alias("n_flagged"), F.try_divide(k, n).alias("fpr"))


SUBSETS = (("stage",), ("stage", "family"), ("stage", "config"), ("stage", "config", "family"))


def subsets(rows: DataFrame) -> DataFrame:
    """Sums of tp, n_pred and n_gold and the number of inputs over the overlapping groups SUBSETS, with ratios (null where
    nothing is to divide)."""
    keys = ("stage", "family", "config")
    of = lambda row, k: F.struct(F.lit(k).alias("_set"), *[(row(c) if c in SUBSETS[k] else F.lit(None)).alias(c) for c in keys])
    each = lambda row: F.array(*[of(row, k) for k in range(len(SUBSETS))])
    sums = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "n_pred", "n_gold")])
    sums = sums.select("tp", "n_pred", "n_gold", F.explode(each(F.col)).alias("g")).groupBy("g").agg(*[F.sum(c).alias(c) for c in ("tp", "n_pred", "n_gold")])
    # An input is moved once, with its different rows, and counts once in each group that they are in.
    inputs = rows.where("input_id is not null").groupBy("input_id").agg(F.collect_set(F.struct(*keys)).alias("_rows"))
    groups = F.array_distinct(F.flatten(F.transform("_rows", lambda x: each(lambda c: x[c]))))
    inputs = inputs.select(F.explode(groups).alias("g")).groupBy("g").agg(F.count("*").alias("n_inputs"))
    out = sums.alias("s").join(inputs.alias("i"), F.col("s.g").eqNullSafe(F.col("i.g")), "left").select("s.g.*", "tp", "n_pred", "n_gold", F.coalesce("n_inputs", F.lit(0)).alias("n_inputs"))
    out = out.drop("_set")
    return out.select("*", *ratios(F.col("tp"), F.col("n_pred"), F.col("n_gold"), None))


def compare_to_baseline(attacked: DataFrame, baseline: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, recall, base_recall, delta_points): each attacked row weighs the baseline row of its input again."""
    b = baseline.select("input_id", F.col("tp").alias("b_tp"), F.col("n_gold").alias("b_gold"))
    out = attacked.join(b, "input_id").groupBy(*by).agg(
        F.count("*").alias("n"), F.try_divide(F.sum("tp"), F.sum("n_gold")).alias("recall"), F.try_divide(F.sum("b_tp"), F.sum("b_gold")).alias("base_recall")
    )
    return out.withColumn("delta_points", (F.col("recall") - F.col("base_recall")) * 100)


def baseline_problems(attacked: DataFrame, baseline: DataFrame) -> DataFrame:
    """(input_id, problem): DUPLICATE_BASELINE, MISSING_BASELINE, TYPES_DIFFER or DUPLICATE_ATTACK."""
    twice = baseline.groupBy("input_id").count().where("count > 1").select("input_id", F.lit("DUPLICATE_BASELINE").alias("problem"))
    none = attacked.join(baseline, "input_id", "left_anti").select("input_id", F.lit("MISSING_BASELINE")).distinct()
    b = baseline.select("input_id", F.array_sort("types").alias("_b"))
    differ = attacked.join(b, "input_id").where(F.array_sort("types") != F.col("_b")).select("input_id", F.lit("TYPES_DIFFER")).distinct()
    again = attacked.groupBy("input_id", "family", "config").count().where("count > 1").select("input_id", F.lit("DUPLICATE_ATTACK")).distinct()
    return twice.union(none).union(differ).union(again)


def privacy_floor(groups: DataFrame, columns: list[str], n: str = "n_inputs", least: int = 5) -> DataFrame:
    """Groups of fewer than `least` inputs with their figures suppressed (null)."""
    return groups.select(*[F.when(F.col(n) >= least, F.col(c)).alias(c) if c in columns else F.col(c) for c in groups.columns], (F.col(n) < least).alias("suppressed"))


def fingerprint(gold: DataFrame, case: str = "case_id") -> DataFrame:
    """(digest, n): SHA-256 over the sorted digests of the cases, each over its sorted spans.

    Digests are put together by their leading hex digits, from groups of about 65,536 at most to one: by two digits up to
    2 ** 24 cases, by two more for each further factor of 256.
    """
    one = F.concat_ws(":", "type", "start", "end")
    cases = gold.groupBy(case).agg(F.sha2(F.concat_ws("|", F.col(case).cast("string"), F.array_sort(F.collect_list(one))), 256).alias("d"))
    cases, levels = saved(cases, "digests"), 1
    n = cases.count()
    while n > 65_536 * 256**levels:
        levels += 1
    parts = cases.groupBy(F.substring("d", 1, 2 * levels).alias("k")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"), F.count("*").alias("n"))
    for level in range(levels - 1, -1, -1):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"]), "")
        parts = parts.groupBy(F.substring("k", 1, 2 * level).alias("k")).agg(F.sha2(joined, 256).alias("d"), F.sum("n").alias("n"))
    return parts.select(F.col("d").alias("digest"), "n")


#: Floors of a release (fixed values): metric, least value.
FLOORS = (("exact_precision", 0.75), ("exact_recall", 0.30), ("exact_f1", 0.42), ("relaxed_f1", 0.45), ("ip_recall", 0.90), ("phone_precision", 0.90))


def gates(metrics: DataFrame, baseline: DataFrame | None = None, floors=FLOORS) -> DataFrame:
    """(metric, value, floor, passed) of metrics (metric, value); metrics of a baseline must not fall below it."""
    f = metrics.sparkSession.createDataFrame(list(floors), "metric string, floor double")
    if baseline is not None:
        f = f.union(baseline.select(F.concat(F.lit("baseline_"), "metric"), "value"))
        metrics = metrics.union(metrics.select(F.concat(F.lit("baseline_"), "metric"), "value"))
    out = f.join(metrics, "metric", "left")
    return out.select("metric", "value", "floor", F.coalesce(F.col("value") >= F.col("floor"), F.lit(False)).alias("passed"))


def deltas(current: DataFrame, baseline: DataFrame, key: str = "type", columns: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    """(key, change of each column); null where a side has no such type."""
    c, b = current.alias("c"), baseline.alias("b")
    j = c.join(b, F.col(f"c.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")
    return j.select(F.coalesce(f"c.{key}", f"b.{key}").alias(key), *[(F.col(f"c.{x}") - F.col(f"b.{x}")).alias(f"d_{x}") for x in columns])


def comparable(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, a, b) of the parameters (key, value) in which two runs differ; none for runs that can be compared."""
    j = a.select("key", F.col("value").alias("a")).join(b.select("key", F.col("value").alias("b")), "key", "full_outer")
    return j.where(~F.col("a").eqNullSafe(F.col("b")))


def rank_corpora(counts: DataFrame, corpus: str = "corpus") -> DataFrame:
    """(corpus, tp, fp, fn, precision, recall, f1, rank): each corpus scored on its own, the best f1 first, equal ones with
    one rank. Corpora are never added up: there is no joint denominator."""
    sums = counts.groupBy(corpus).agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_gold").alias("n_gold"))
    tp, p, g = F.col("tp"), F.col("n_pred"), F.col("n_gold")
    out = sums.select(corpus, "tp", (p - tp).alias("fp"), (g - tp).alias("fn"), *ratios(tp, p, g))
    return out.withColumn("rank", F.rank().over(W.orderBy(F.desc("f1"))))  # one row a corpus
