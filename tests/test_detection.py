"""Recognizers, windows and masking on written cases."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import checksums as ck
from brindle.functions.recognizers import FINDERS, NAMES
from brindle.functions.spans import merge_spans
from brindle.operators import detect as d
from brindle.operators import masking as m
from brindle.sources import corpora as co

E, P, C, I, B, N, S, Q, O = NAMES
CASES = [
    ("write a.b+c@ex-ample.com, please", E, ["a.b+c@ex-ample.com"]),
    ("mail fred @ corp . com now", E, ["fred @ corp . com"]),
    ("a@b and a..b@c.de .x@y.com a@b.com.", E, []),
    ("éa@b.com x - a@b.com a    @b.com", E, []),
    ("почта: me@пример.рф тут", E, ["me@пример.рф"]),
    ("+7 (903) 518-24-60 or 89035182460", P, ["+7 (903) 518-24-60", "89035182460"]),
    ("тел 903 518 24 69; far far away from any such word 903 518 24 60", P, ["903 518 24 69"]),
    ("телескоп 903 518 24 69", P, []),
    ("12 8 903 518 24 69 and 8--903 518 24 69 and 8 903 518 24 69.5", P, []),
    ("cards 4111 1111 1111 1111, 5500-0000-0000-0004 no 4111111111111112", C, ["4111 1111 1111 1111", "5500-0000-0000-0004"]),
    ("0000000000000000 4111  1111 1111 1111 -4111111111111111-", C, []),
    ("10.0.0.1:8080 1.2.3.4.5 01.2.3.4 1.2.3.4:0 end 9.9.9.9.", I, ["10.0.0.1", "9.9.9.9"]),
    ("::1 fe80::1%eth0 2001:db8:5::a1:77f0 ::ffff:1.2.3.4 1:2:3:4:5:6:7:8 1:2:3", I, ["::1", "2001:db8:5::a1:77f0", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8"]),
    ("DE89370400440532013000 DE89 3704 0044 0532 0130 00 DE88370400440532013000 gb82west12345698765432", B, ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "gb82west12345698765432"]),
    ("500100732259 500100732258 1500100732259", N, ["500100732259"]),
    ("152-637-480 69 152 637 480 69 15263748069 152-637-480 68 001-001-998 00", S, ["152-637-480 69", "152 637 480 69", "15263748069"]),
    ("СНИЛС: 152-637-480 68", S, ["152-637-480 68"]),
    ("паспорт 4509 123456; " + "z" * 80 + " 45 09 123456", Q, ["4509 123456"]),
    ("серия и номер 45-09 123456", Q, ["45-09 123456"]),
    ("полис ОМС 1234567890123456 and far" + " x" * 40 + " 1234567890123450", O, ["1234567890123456"]),
    ("полис обязательного медицинского страхования 1234 5678 9012 3456", O, ["1234 5678 9012 3456"]),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(CASES)], "k int, text string")
    out = df.select("k", "text", F.struct(*[f(F.col("text")).alias(n) for n, f in FINDERS.items()]).alias("f")).collect()
    return {r.k: r for r in out}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_recognizers(found, k):
    text, kind, want = CASES[k]
    raw = text.encode()
    assert [raw[x.start_utf8 : x.end_utf8].decode() for x in found[k].f[kind]] == want


def test_checksums_by_plain_arithmetic(spark):
    def inn(s):
        x = [int(c) for c in s]
        a = sum(p * q for p, q in zip(ck.INN_11, x)) % 11 % 10
        return a == x[10] and sum(p * q for p, q in zip(ck.INN_12, x)) % 11 % 10 == x[11]

    def oms(s):
        x = [int(c) for c in s[:15]][::-1]
        odd, even = int("".join(map(str, x[::2]))[::-1]), sum(x[1::2])
        return (10 - (sum(map(int, str(2 * odd))) + even) % 10) % 10 == int(s[15])

    df = spark.range(200).select(co.inn_of(F.col("id") * 7919).alias("i"), co.oms_of(F.col("id") * 104729).alias("o"))
    for r in df.select("i", "o", ck.inn_person(F.col("i")).alias("a"), ck.oms(F.col("o")).alias("b")).collect():
        assert r.a and r.b and inn(r.i) and oms(r.o)


def test_windows_find_what_whole_texts_do(spark):
    text = "é" * 37 + " a@b.com " + "😀" * 30 + " 4111 1111 1111 1111 " + "я" * 50 + " 10.1.2.3 "
    df = spark.createDataFrame([(1, text), (2, "")], "id int, text string")
    whole = {r.id: sorted((f.start_utf8, f.end_utf8, f.type) for f in r.findings) for r in d.detect_pii(df).collect()}
    for window, entity in ((64, 24), (90, 30), (4096, 100)):
        got = {r.id: [(f.start_utf8, f.end_utf8, f.type) for f in r.findings] for r in d.detect_windowed(df, ["id"], window=window, entity=entity).collect()}
        assert got == whole


def test_texts_above_the_limit_are_searched(spark):
    text = "я" * 80 + " 10.1.2.3 " + "é" * 90 + " a@b.com " + "x" * 70 + " 4111 1111 1111 1111 "
    df = spark.createDataFrame([(1, text), (1, text), (2, "b@c.com"), (None, ""), (3, None)], "id int, text string")
    key = lambda r: (r.id is None, r.id or 0)
    want = sorted(d.detect_pii(df).collect(), key=key)
    got = sorted(d.detect_any_size(df, limit=128, entity=24).collect(), key=key)
    assert got == want and len(want[0].findings) == 4  # the card is a policy number too
    assert d.detect_pii(df, limit=128).where("findings is null").count() == 2


def test_document_queries_count_texts_above_one_mib(spark, tmp_path):
    from brindle import plans

    rows = [(1, "en", "word " * 220_000 + " a@b.com "), (2, "en", "c@d.com")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.type, r.lang): r.n for r in plans.queries()["d10_documents"](spark, str(tmp_path)).collect()}
    assert got == {(E, "en"): 2}


def test_window_arguments():
    assert d.check_windowing(1048576, 4096) is None
    assert d.check_windowing(10, 5) == d.check_windowing(0, 1) == d.check_windowing(10, 2, " ") == "INVALID_CAPABILITY"


def test_first_finding_is_of_the_first_type(spark):
    df = spark.createDataFrame([("host 10.0.0.1 card 4111 1111 1111 1111",)], "text string")
    assert d.detect_pii(df, stop_on_first=True).first().findings[0].type == C
    assert d.detect_pii(df, types=[]).first().findings == []
    assert [f.type for f in d.detect_pii(df, types=[I, C]).first().findings] == [C, I]


def test_preflight_codes(spark):
    df = spark.createDataFrame([("é" * 10,), ("",)], "text string")
    assert [r.error_code for r in d.preflight(df, limit=19).collect()] == ["PAYLOAD_TOO_LARGE", None]


def test_masking(spark):
    df = spark.createDataFrame([("é me@ex.com or 4111 1111 1111 1111!",)], "text string")
    r = m.mask_documents(d.detect_pii(df, types=[E, C])).first()
    assert r.masked == "é [EMAIL_MASKED] or [CARD_MASKED]!"
    again = m.mask_documents(d.detect_pii(spark.createDataFrame([(r.masked,)], "text string"))).first()
    assert again.masked == r.masked and not again.findings


def test_islands_and_short_markers(spark):
    s = "array(named_struct('start',1L,'end',5L,'marker','[A]'),named_struct('start',5L,'end',7L,'marker','[A]'),named_struct('start',9L,'end',12L,'marker','[A]'),named_struct('start',10L,'end',11L,'marker','[B]'))"
    got = spark.sql(f"select {s} s").select(merge_spans(F.col("s")).alias("m")).first().m
    assert [tuple(x) for x in got] == [(1, 7, "[A]"), (9, 12, "[PII_MASKED]")]
    sizes = spark.createDataFrame([(1,), (2,), (6,), (20,)], "n int").select(m.short_marker(F.lit("[EMAIL_MASKED]"), F.col("n")).alias("x"))
    assert [r.x for r in sizes.collect()] == ["*", "**", "[EMAI]", "[EMAIL_MASKED]"]


def test_masking_errors(spark):
    span = lambda a, b, mk: F.array(F.struct(F.lit(a).cast("bigint").alias("start"), F.lit(b).cast("bigint").alias("end"), F.lit(mk).alias("marker")))
    t = F.lit("éa")
    cols = [m.masking_error(t, span(*a)).alias(f"c{k}") for k, a in enumerate([(0, 9, "[A]"), (1, 3, "[A]"), (0, 2, "a"), (0, 2, "[A]")])]
    assert list(spark.range(1).select(*cols).first()) == ["OUT_OF_RANGE", "UTF8_BOUNDARY", "INVALID_MARKER", None]


def test_deltas_carry_one_marker(spark):
    df = spark.createDataFrame([(1, 0, "ab"), (1, 1, "cd"), (1, 2, "ef"), (1, 3, "gh")], "k int, seq int, delta string")
    isl = spark.createDataFrame([(1, 1, 5, "[X]"), (1, 7, 8, "[Y]")], "k int, start bigint, end bigint, marker string")
    got = [r.masked_delta for r in m.mask_deltas(df, isl, ["k"]).orderBy("seq").collect()]
    assert got == ["a[X]", "", "f", "g[Y]"]


def test_detectors_and_invalid_results(spark):
    bad = lambda t: F.array(F.struct(F.lit("X").alias("type"), F.lit(1).cast("bigint").alias("start_utf8"), F.lit(2).cast("bigint").alias("end_utf8"), F.lit(None).cast("double").alias("confidence"), F.lit("e").alias("evidence"), F.lit("r").alias("recognizer_id"), F.lit("1").alias("recognizer_version")))
    d.register_detector("bad", bad)
    df = spark.createDataFrame([("éé",)], "text string")
    got = {r.detector_id: (r.status, r.error_code) for r in d.run_detectors(df, ["fast-pii", "bad", "none"]).collect()}
    assert got == {"fast-pii": ("CLEAN", None), "bad": ("ERROR", "INVALID_DETECTOR_RESULT"), "none": ("ERROR", "UNKNOWN_DETECTOR")}


def test_url_hosts(spark):
    df = spark.createDataFrame([("see http://10.0.0.1:80/x ok", 4, 24), ("at 1.2.3.4:99", 3, 13), ("at http://ab.c/", 3, 15)], "text string, a bigint, b bigint")
    got = [(r.host_start, r.host_end) for r in d.annotate_url_hosts(df, "text", "a", "b").collect()]
    assert got == [(11, 19), (3, 10), (None, None)]


HOSTILE = {
    "labels": "a@" + ".".join(["b"] * 350_000),
    "spaced labels": "a @ " + " . ".join(["b"] * 200_000),
    "locals": "a." * 350_000 + "@b.com",
    "ats": "a@b." * 250_000,
    "units": ":".join(["1"] * 500_000),
    "colons": ":" * 1_000_000,
    "octets": "1." * 500_000,
    "digits": "7" * 1_000_000,
    "spaced digits": "4 " * 500_000,
    "dashed digits": "123-" * 250_000,
    "brackets": "(" * 500_000 + "8" * 500_000,
    "groups": "DE89 " + "1234 " * 200_000,
    "letters": "D" * 500_000 + "E89" * 160_000,
    "series": "паспорт 45 09 " * 30_000,
    "polis": "полис обязательного " * 25_000 + "1234567890123456",
}


def test_hostile_texts_do_not_end_the_session(spark):
    # a megabyte where a pattern repeats a group, the start of the others: evidence of many matches is quadratic in the text
    rows = [(k, t if k in ("labels", "units", "colons", "ats") else t[:50_000]) for k, t in HOSTILE.items()]
    df = spark.createDataFrame(rows, "k string, text string").repartition(8)
    out = df.select("k", *[F.size(f(F.col("text"))).alias(n) for n, f in FINDERS.items()]).collect()
    assert len(out) == len(rows)
    assert spark.range(3).count() == 3


def test_long_domains_are_no_addresses_and_the_next_one_is_found(spark):
    text = "a@" + ".".join(["b"] * 3000) + " c@d.com " + ":".join(["1"] * 20000) + " ::1"
    df = spark.createDataFrame([(text,)], "text string")
    r = df.select(FINDERS[E](F.col("text")).alias("e"), FINDERS[I](F.col("text")).alias("i")).first()
    raw = text.encode()
    assert [raw[x.start_utf8 : x.end_utf8] for x in r.e] == [b"c@d.com"] and [raw[x.start_utf8 : x.end_utf8] for x in r.i] == [b"::1"]


def test_masking_of_many_findings_is_linear(spark):
    df = spark.range(1).select(F.repeat(F.lit("é 10.1.2.3 ж "), 20000).alias("text"))
    r = m.mask_documents(d.detect_pii(df, types=[I])).first()
    assert r.masked == "é [IP_MASKED] ж " * 20000


def test_addresses_parted_by_one_character_all_count(spark, tmp_path):
    from brindle.plans import detection

    rows = [(1, "to ann.63@a.example.com bob.70@b.example.com at 10.1.2.3 10.1.2.4"), (2, "ann@a.example.com\nbob@b.example.com\n10.1.2.3\n10.1.2.4\n10.1.2.4")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in detection.d1_email_documents(spark, str(tmp_path)).collect()} == {(1, 2), (2, 2)}
    assert {tuple(r) for r in detection.d4_ipv4_values(spark, str(tmp_path)).collect()} == {("10.1.2.3", 2, 2), ("10.1.2.4", 3, 2)}
