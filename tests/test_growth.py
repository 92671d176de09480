"""Work of a query that must not be done twice or grow faster than its input."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brindle.operators import audit
from brindle.operators import chat as ch
from brindle.functions import checksums, spans, tables
from brindle.operators import masking as ma
from brindle.operators import quality as qu
from brindle.plans import evaluation, pipelines, rules, traffic
from brindle.streaming import streams as st
from test_queries import SF
from test_streams import START, progress_of


def test_bodies_are_parsed_once(spark):
    df = spark.createDataFrame([(1, '{"messages":[{"role":"user","content":"a"}]}'), (2, " [1]"), (3, '{"a":1,"a":2}'), (4, "{"), (5, None)], "k int, body string")
    scanned = ch.scan_requests(df)
    assert {r.k: r.reject for r in scanned.collect()} == {1: None, 2: "MALFORMED_MESSAGE", 3: "AMBIGUOUS_CONTENT", 4: "MALFORMED_MESSAGE", 5: "MALFORMED_MESSAGE"}
    plan = ch.fragments_from_requests(scanned, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


@pytest.mark.parametrize("name", ["n2_tool_fragments", "n3_references", "n2_n3_request_fields"])
def test_requests_of_a_small_file_are_made_by_all_tasks(spark, tmp_path, name, monkeypatch):
    spark.read.parquet(f"{SF}/part.parquet").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    seen = []
    scan = ch.scan_requests
    monkeypatch.setattr(ch, "scan_requests", lambda df: seen.append(df.select(F.spark_partition_id().alias("p")).distinct().count()) or scan(df))
    getattr(rules, name)(spark, str(tmp_path))
    assert seen == [4]


def test_open_spans_are_state_of_groups(spark, tmp_path):
    rows = [(i, START, False) for i in range(200)]
    spark.createDataFrame(rows, "span_id long, at long, ended boolean").select("span_id", F.timestamp_seconds("at").alias("ts"), "ended").repartition(1).write.parquet(str(tmp_path / "in"))
    s = st.stream_table(spark, str(tmp_path / "in"), 1)
    out = st.deadlines(s.where("not ended").select("span_id", "ts"), s.where("ended").select("span_id", "ts"), "20 seconds", "60 seconds", groups=4)
    got, progress = progress_of(out, tmp_path)
    assert not got and 0 < progress[-1]["stateOperators"][0]["numRowsTotal"] <= 3 * 4


def test_deadlines_of_mixed_spans_equal_a_fold(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for k in range(3):
        for i in range(300):
            t = START + k * 100 + rng.randrange(40)
            rows += [(k, k * 300 + i, t, False)] * rng.choice((1, 2)) + ([(k, k * 300 + i, t + rng.choice((-5, 3, 19, 20, 21, 35)), True)] if rng.random() < 0.7 else [])
    rows.append((3, -1, START + 9000, False))
    rows.append((3, -1, START + 9000, True))
    for k in range(4):
        part = [(s, t, e) for n, s, t, e in rows if n == k]
        spark.createDataFrame(part, "span_id long, at long, ended boolean").select("span_id", F.timestamp_seconds("at").alias("ts"), "ended").repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = st.stream_table(spark, str(tmp_path / "in"), 1)
    got, _ = progress_of(st.deadlines(s.where("not ended").select("span_id", "ts"), s.where("ended").select("span_id", "ts"), "20 seconds", "200 seconds", groups=7), tmp_path)
    started = {s: t for _, s, t, e in rows if not e}
    in_time = {s for _, s, t, e in rows if e and t <= started[s] + 20}
    assert sorted(r[0] for r in got) == sorted(set(started) - in_time)


def test_bio_spans_do_not_move_texts(spark):
    rows = [
        (1, "ab  é cd ab", ["ab", "é", "cd", "ab"], ["B-X", "I-X", "O", "I-Y"]),
        (2, "ab cd", ["cd", "ab"], ["B-X", "I-X"]), (3, None, ["a"], ["B-X"]), (4, "a b", ["a", "b"], ["I-Z", None]), (5, "a", None, ["B-X"]), (6, "a", ["a"], ["O", "B-X"]),
    ]
    df = spark.createDataFrame(rows, "k int, text string, tokens array<string>, tags array<string>")
    out = ch.bio_to_spans(df, ["k"])
    want = [(1, "X", 0, 6), (1, "Y", 10, 12), (2, "X", None, None), (3, "X", None, None), (4, "Z", 0, 1), (6, "X", None, None)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_open_streams_are_state_of_groups_and_time_out_alone(spark, tmp_path):
    # batch 0: 60 streams begin; batch 1: every third ends, every third fails, others are silent; batch 2 moves the watermark
    first = [(f"s{i}", 1, "b", False, False, START) for i in range(60)]
    second = [(f"s{i}", 0, "a", i % 3 == 0, i % 3 == 1, START + 5) for i in range(60) if i % 3 < 2]
    for rows in (first, second, [("late", 0, "x", False, False, START + 1000)], [("late", 1, "y", True, False, START + 1001)]):
        df = spark.createDataFrame(rows, "stream_id string, seq long, delta string, done boolean, failed boolean, at long")
        df.withColumn("ts", F.timestamp_seconds("at")).drop("at").repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    got, progress = progress_of(st.reassemble_live(st.stream_table(spark, str(tmp_path / "in"), 1), "1 minute", groups=4), tmp_path)
    want = [(f"s{i}", "COMPLETE", "ab", 2) if i % 3 == 0 else (f"s{i}", "FAILED", "", 2 if i % 3 == 1 else 1) for i in range(60)]
    assert sorted(r[:4] for r in got) == sorted([*want, ("late", "COMPLETE", "xy", 2)])
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 4


def test_cached_subjects_are_state_of_groups(spark, tmp_path):
    big = (1 << 60) + 1
    for k in range(2):
        rows = [(s, k * 100 + n, START + k * 200 + n, True) for n, s in enumerate([*range(40), big, None])]
        df = spark.createDataFrame(rows, "subject long, event_id long, at long, ok boolean")
        df.select("subject", "event_id", F.timestamp_seconds("at").alias("ts"), "ok").repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    got, progress = progress_of(st.cached_identities(st.stream_table(spark, str(tmp_path / "in"), 1), 300, groups=4), tmp_path)
    want = [(s, k * 100 + n, "HIT" if k else "MISS") for k in range(2) for n, s in enumerate([*range(40), big, None])]
    assert sorted((r[:3] for r in got), key=repr) == sorted(want, key=repr)
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 4


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_bio_files_hold_so_many_records(spark, monkeypatch):
    monkeypatch.setattr(pipelines, "BIO_RECORDS", 50)
    assert len(pipelines.s2_bio_corpus(spark, SF).inputFiles()) >= 4


def test_equal_spans_are_one_island(spark):
    rows = [(1, 3, 9, "R"), (1, 3, 9, "R"), (1, 9, 12, "A"), (1, 15, 22, "R"), (1, 22, 27, "N"), (1, 40, 42, "N"), (1, 40, 42, "N")]
    df = spark.createDataFrame(rows, "k long, start long, end long, marker string")
    want = [(3, 12, "[PII_MASKED]"), (15, 27, "[PII_MASKED]"), (40, 42, "N")]
    assert sorted(map(tuple, ma.merge_span_rows(df, ["k"]).select("start", "end", "marker").collect())) == want
    one = df.agg(F.collect_list(F.struct("start", "end", "marker")).alias("s")).select(ma.merge_spans(F.col("s")).alias("m")).first().m
    assert [tuple(x) for x in one] == want


def test_lines_meet_equal_values_once(spark):
    # all lines hold the gram of a value that 3,000 ids have; one line holds the value, two a short value of 3,000 ids
    lines = spark.createDataFrame([(k, f"a hot ring {k}" if k else "a hot rings hotel") for k in range(40)], "k int, line string")
    lines = lines.withColumn("line", F.when(F.col("k") % 20 == 7, F.concat("line", F.lit(" xyz"))).otherwise(F.col("line")))
    values = spark.range(9000).select(F.col("id").alias("value_id"), F.element_at(F.array(*map(F.lit, ("hot rings", "xyz", "nothing at all"))), (F.col("id") % 3 + 1).cast("int")).alias("value"))
    values = values.union(spark.createDataFrame([(None, "xyz"), (-1, None)], "value_id long, value string"))
    out = audit.scan_leaks(lines, values, limit=700)
    got = sorted(((r.k, r.value_id) for r in out.collect()), key=repr)
    assert got == sorted([(0, v) for v in range(0, 9000, 3)] + [(k, v) for k in (7, 27) for v in [*range(1, 9000, 3), None]], key=repr)
    assert audit.gram_index(values.select("value").distinct()).count() == 2


def _exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan


def test_patches_are_dealt_to_bounded_tasks_once(spark, monkeypatch):
    rows = [(k, o, o, 10 * o, 10 * o + 3) for k in range(60) for o in range(3)]
    rows += [(100, 1, 1, 0, 3), (100, 1, 2, 5, 6), (101, 1, 7, 0, 3), (101, 2, 7, 5, 6), (102, 1, 1, 0, 6), (102, 2, 2, 5, 6), (103, None, 1, 0, 1), (104, 1, None, 0, 1), (None, 1, 1, 0, 6)]
    df = spark.createDataFrame(rows, "k int, ordinal int, locator int, start int, end int")
    monkeypatch.setattr(tables, "TASK_ROWS", 20)
    out = ma.check_patches(df, ["k"])
    want = {k: None for k in range(60)} | {100: "DUPLICATE_ORDINAL", 101: "DUPLICATE_LOCATOR", 102: "OVERLAP", 103: "DUPLICATE_ORDINAL", 104: "DUPLICATE_LOCATOR", None: None}
    plan = _exchanges(out)
    assert {r.k: r.error_code for r in out.collect()} == want
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(k#" in plan and ", 10)" in plan and "Expand" not in plan


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_audited_orders_are_dealt_to_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 1000)
    plan = _exchanges(traffic.a3_a5_audit_counts(spark, SF))
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") > 0


def test_inputs_of_subsets_are_moved_once(spark):
    rows = [("s", "f", 1, 1), ("s", "f", 2, 1), ("s", "g", 1, 1), ("s", None, 1, 2), (None, "f", 1, None), ("t", "f", 1, None), ("t", "f", 1, 3), ("t", "f", 1, 3)]
    df = spark.createDataFrame([(*r, 1, 2, 0) for r in rows], "stage string, family string, config int, input_id int, tp int, n_pred int, n_gold int")
    out = qu.subsets(df)
    got = sorted(((r.stage, r.family, r.config, r.tp, r.n_inputs, r.precision, r.recall) for r in out.collect()), key=repr)
    want = df.groupingSets([[F.col(c) for c in s] for s in qu.SUBSETS], "stage", "family", "config").agg(F.sum("tp").alias("tp"), F.count_distinct("input_id").alias("n")).collect()
    assert got == sorted(((r.stage, r.family, r.config, r.tp, r.n, 0.5, None) for r in want), key=repr)
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_gates_scan_their_scores_once(spark):
    plan = evaluation.e21_gates(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") <= 2


def test_masking_stream_has_work_for_all_cores(spark):
    n = spark.sparkContext.defaultParallelism
    assert pipelines.mask_files(spark, 150) == (4, 2)
    assert pipelines.mask_files(spark, 9_000_000) == (180, min(90, 4 * n))
    assert n <= pipelines.mask_files(spark, 54_000_000)[1] <= 4 * n


def test_texts_of_one_match_are_not_split(spark):
    # split compiles its pattern for each text; the place of a single match comes from what stands before it
    rows = [(1, "é\n12 x"), (2, "12"), (3, "no"), (4, "é1 b22\nü333"), (5, "\n\nab 7\n\n"), (6, "")]
    df = spark.createDataFrame(rows, "k int, t string").select("k", spans.matches(F.col("t"), "[0-9]+").alias("m"))
    got = {r.k: [tuple(x) for x in r.m] for r in df.collect()}
    want = {1: [("12", 2, 3, 5)], 2: [("12", 0, 0, 2)], 3: [], 4: [("1", 1, 2, 3), ("22", 4, 5, 7), ("333", 8, 10, 13)], 5: [("7", 5, 5, 6)], 6: []}
    assert got == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan


def test_mod97_of_letters_and_digits(spark):
    values = ["GB82WEST12345698765432", "DE89370400440532013000", "NO9386011117947", "AZ21NABZ00000000137010001944"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(checksums.mod97(F.col("v")).alias("r"), checksums.mod97(F.concat(F.lit("XK05"), F.substring("v", 5, 40))).alias("o"))
    number = lambda v: int("".join(str(int(c, 36)) for c in v[4:] + v[:4]))
    assert [tuple(r) for r in df.collect()] == [(1, number("XK05" + v[4:]) % 97) for v in values]
