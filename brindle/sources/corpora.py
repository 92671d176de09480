"""Corpus, policy and report sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions.recognizers import NAMES

HEADER = "# pii-corpus-v1"


def with_reason(df: DataFrame, rules: list[tuple[str, Column]], to: str = "reason") -> DataFrame:
    """df with the code of the first rule that holds, or null; codes never repeat the payload."""
    code = reduce(lambda acc, r: acc.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0]))
    return df.withColumn(to, code)


def split_rejects(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(accepted rows without the reason, rejected rows)."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def read_canonical_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(file, case_id, types, text, findings, reason) of TSV files: case, enabled types or *, Base64 text, findings of six
    fields separated by ;. Rejected rows have a reason and no text."""
    raw = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    f = F.split("value", "\t", -1)
    raw = raw.withColumn("f", f).withColumn("n", F.size("f"))
    data = F.try_to_binary(F.try_element_at("f", F.lit(3)), F.lit("base64"))
    raw = raw.withColumn("case_id", F.try_element_at("f", F.lit(1))).withColumn("_bin", data).withColumn("_text", F.try_validate_utf8(F.decode("_bin", "UTF-8")))
    kinds = F.try_element_at("f", F.lit(2))
    raw = raw.withColumn("types", F.when(kinds == "*", F.array(*map(F.lit, NAMES))).otherwise(F.split(kinds, ",")))
    one = lambda x: F.split(x, ":", -1)
    fields = F.try_element_at("f", F.lit(4))
    items = F.when(fields == "", F.array().cast("array<string>")).otherwise(F.split(fields, ";"))
    raw = raw.withColumn("_items", items)
    raw = raw.withColumn("findings", F.transform("_items", lambda x: F.struct(
        one(x)[0].alias("type"), F.try_element_at(one(x), F.lit(2)).try_cast("bigint").alias("start_utf8"), F.try_element_at(one(x), F.lit(3)).try_cast("bigint").alias("end_utf8"),
        F.try_element_at(one(x), F.lit(4)).alias("evidence"), F.try_element_at(one(x), F.lit(5)).alias("recognizer_id"), F.try_element_at(one(x), F.lit(6)).alias("recognizer_version"))))
    again = F.count("*").over(W.partitionBy("case_id"))
    bad_span = F.exists("findings", lambda x: x["start_utf8"].isNull() | x["end_utf8"].isNull() | (x["start_utf8"] >= x["end_utf8"]) | (x["end_utf8"] > F.octet_length("_bin")))
    out = with_reason(raw.withColumn("_n", again), [
        ("COLUMN_COUNT", F.col("n") != 4),
        ("BLANK_CASE_ID", F.trim("case_id") == ""),
        ("DUPLICATE_CASE_ID", F.col("_n") > 1),
        ("UNKNOWN_TYPE", F.size(F.array_except("types", F.array(*map(F.lit, NAMES)))) > 0),
        ("INVALID_BASE64", F.col("_bin").isNull()),
        ("INVALID_UTF8", F.col("_text").isNull()),
        ("FINDING_FIELDS", F.exists("_items", lambda x: F.size(one(x)) != 6)),
        ("INVALID_SPAN", bad_span),
    ])
    return out.select("file", "case_id", "types", F.when(F.col("reason").isNull(), F.col("_text")).alias("text"), "findings", "reason")


def read_bio_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, text, tokens, tags, reason) of CSV files with JSON arrays of tokens and BIO tags."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', schema="case_id string, text string, tokens string, tags string")
    df = raw.withColumn("tokens", F.from_json("tokens", "array<string>")).withColumn("tags", F.from_json("tags", "array<string>"))
    before = lambda i: F.when(i > 0, F.element_at("tags", i)).otherwise(F.lit("O"))
    jump = F.exists(F.transform("tags", lambda t, i: t.startswith("I-") & ~F.substring(before(i), F.lit(3), F.lit(99)).eqNullSafe(F.substring(t, F.lit(3), F.lit(99)))), lambda x: x)
    return with_reason(df, [
        ("MALFORMED_ARRAY", F.col("tokens").isNull() | F.col("tags").isNull()),
        ("LENGTH_MISMATCH", F.size("tokens") != F.size("tags")),
        ("INVALID_TAG", F.exists("tags", lambda t: ~t.rlike(r"\A(?:O|[BI]-.+)\z"))),
        ("INVALID_TRANSITION", jump),
    ])


SPAN_SCHEMA = "id string, domain string, text string, entities array<struct<start:int,end:int,text:string,type:string>>"


def read_span_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, domain, text, entities, reason) of Parquet files with annotated code-point spans."""
    df = spark.read.schema(SPAN_SCHEMA).parquet(path)
    out = F.exists("entities", lambda e: (e["start"] < 0) | (e["start"] >= e["end"]) | (e["end"] > F.length("text")))
    wrong = F.exists("entities", lambda e: F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"]) != e["text"])
    return with_reason(df, [("MISSING_FIELD", F.col("id").isNull() | F.col("text").isNull() | F.col("entities").isNull()), ("SPAN_RANGE", out), ("SLICE_MISMATCH", wrong)])


ATTACK_SCHEMA = (
    "uid string, input_id string, category string, attack_target struct<pii:boolean,context:boolean>, llm_input string, "
    "pii_spans array<struct<start:int,end:int,text:string,type:string>>"
)


def read_attack_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of attacked inputs; one bad row fails the whole read."""
    df = spark.read.schema(ATTACK_SCHEMA).parquet(path)
    ok = F.forall("pii_spans", lambda e: (e["start"] >= 0) & (e["start"] < e["end"]) & (F.substring(F.col("llm_input"), e["start"] + 1, e["end"] - e["start"]) == e["text"]))
    good = F.coalesce(F.col("uid").isNotNull() & F.col("input_id").isNotNull() & ok, F.lit(False))
    return df.withColumn("uid", F.when(good, F.col("uid")).otherwise(F.raise_error(F.lit("INVALID_ATTACK_ROW"))))


def verify_files(spark: SparkSession, glob: str, pins: DataFrame) -> DataFrame:
    """(name, verdict) of files against pins (name, size, sha256): OK, SIZE, SHA256, MISSING or UNEXPECTED."""
    files = spark.read.format("binaryFile").load(glob).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("_n"), F.sha2("content", 256).alias("_h"))
    j = pins.join(files, "name", "full_outer")
    verdict = F.when(F.col("_n").isNull(), "MISSING").when(F.col("size").isNull(), "UNEXPECTED").when(F.col("_n") != F.col("size"), "SIZE").when(F.col("_h") != F.col("sha256"), "SHA256").otherwise("OK")
    return j.select("name", verdict.alias("verdict"))


POLICY_JSON = (
    "policies array<struct<id:string,version:string,enabled:boolean,url:string,model:string,phase:string,subject_kind:string,subject:string,"
    "detectors:array<string>,deadline_ms:bigint,on_detected:string,on_clean:string,on_error:string,mask:boolean,overrides:array<string>>>"
)
POLICY_FIELDS = ("id", "version", "enabled", "url", "model", "phase", "subject_kind", "subject", "detectors", "deadline_ms", "on_detected", "on_clean", "on_error", "mask", "overrides")


def read_policies(spark: SparkSession, path: str, default_deadline_ms: int = 50) -> DataFrame:
    """Policies of JSON documents, with unknown_fields: names that no policy may have."""
    raw = spark.read.text(path, wholetext=True)
    doc = raw.select(F.from_json("value", POLICY_JSON).alias("d"), F.from_json(F.get_json_object("value", "$.policies"), "array<map<string,string>>").alias("m"))
    rows = doc.select(F.inline(F.arrays_zip(F.col("d.policies").alias("p"), "m")))
    unknown = F.array_except(F.map_keys("m"), F.array(*map(F.lit, POLICY_FIELDS)))
    p = rows.select("p.*", F.array_sort(unknown).alias("unknown_fields")).withColumnRenamed("id", "policy_id")
    empty = F.array().cast("array<string>")
    return p.withColumn("deadline_ms", F.coalesce("deadline_ms", F.lit(default_deadline_ms))).withColumn("enabled", F.coalesce("enabled", F.lit(True))).withColumn(
        "mask", F.coalesce("mask", F.lit(False))).withColumn("overrides", F.coalesce("overrides", empty)).withColumn("detectors", F.coalesce("detectors", empty))


def iban_registry(spark: SparkSession) -> DataFrame:
    """(country, length) of the IBAN registry."""
    from brindle.functions.checksums import IBAN_LENGTHS

    return spark.createDataFrame(sorted(IBAN_LENGTHS.items()), "country string, length int")


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Rows (benchmark, mode, params, score, p50, p95, p99) of benchmark JSON files."""
    schema = "benchmark string, mode string, params map<string,string>, primaryMetric struct<score:double,scorePercentiles:map<string,double>>"
    df = spark.read.schema(schema).json(path, multiLine=True)
    at = lambda p: F.try_element_at("primaryMetric.scorePercentiles", F.lit(p))
    return df.select("benchmark", "mode", "params", F.col("primaryMetric.score").alias("score"), at("50.0").alias("p50"), at("95.0").alias("p95"), at("99.0").alias("p99"))


def read_testcases(spark: SparkSession, path: str) -> DataFrame:
    """(task, class, name, seconds, failed, reason) of JUnit XML files; duplicate cases have a reason."""
    schema = "_classname string, _name string, _time double, failure string, error string"
    df = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    task = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    out = df.select(task.alias("task"), F.col("_classname").alias("class"), F.col("_name").alias("name"), F.col("_time").alias("seconds"), (F.col("failure").isNotNull() | F.col("error").isNotNull()).alias("failed"))
    n = F.count("*").over(W.partitionBy("task", "class", "name"))
    return with_reason(out.withColumn("_n", n), [("DUPLICATE_CASE", F.col("_n") > 1)]).drop("_n")


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """(ts, level, message, event, fields) of JSON log lines; other lines are left out. Of repeated keys the first counts."""
    schema = "timestamp string, level string, message string, kvpList array<map<string,string>>"
    raw = spark.read.text(path).select(F.from_json("value", schema).alias("j")).where("j is not null and (j.message is not null or j.kvpList is not null)")
    entries = F.flatten(F.transform("j.kvpList", lambda m: F.map_entries(m)))
    first = F.aggregate(entries, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, e: F.when(F.exists(acc, lambda x: x["key"] == e["key"]), acc).otherwise(F.concat(acc, F.array(e))))
    fields = F.map_from_entries(F.coalesce(first, F.array().cast("array<struct<key:string,value:string>>")))
    return raw.select(F.try_to_timestamp("j.timestamp").alias("ts"), "j.level", "j.message", F.try_element_at(fields, F.lit("event")).alias("event"), fields.alias("fields"))


def write_report(df: DataFrame, path: str, by: list[str] | None = None, kind: str = "parquet") -> None:
    """A report as files by view and scope, replaced in place; report.publish_report is the one that readers see whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).format(kind).save(path)


def write_audit(df: DataFrame, path: str) -> None:
    """One JSON line for each event; columns of texts are refused."""
    if bad := {"text", "value", "masked", "body"} & set(df.columns):
        raise ValueError(f"an audit event has no {sorted(bad)}")
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


# ------------------------------------------------------------------ planted values


def inn_of(n: Column) -> Column:
    from brindle.functions import checksums as ck

    base = F.lpad(n.cast("string"), 10, "1")
    d11 = (ck.weighted(base, ck.INN_11) % 11 % 10).cast("string")
    eleven = F.concat(base, d11)
    return F.concat(eleven, (ck.weighted(eleven, ck.INN_12) % 11 % 10).cast("string"))


def snils_of(n: Column) -> Column:
    from brindle.functions import checksums as ck

    base = F.lpad((n + 100_000_000).cast("string"), 9, "0")
    return F.concat_ws("-", F.substring(base, 1, 3), F.substring(base, 4, 3), F.concat(F.substring(base, 7, 3), F.lit(" "), ck.snils_check(base)))


def oms_of(n: Column) -> Column:
    from brindle.functions import checksums as ck

    base = F.lpad(n.cast("string"), 15, "7")
    return F.concat(base, ck.oms_check(base).cast("string"))


def card_of(n: Column) -> Column:
    from brindle.functions import checksums as ck

    base = F.concat(F.lit("4"), F.lpad(n.cast("string"), 14, "0"))
    d = F.reverse(ck.digits(base))
    total = F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 1, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))), F.lit(0), lambda a, x: a + x)
    return F.concat(base, F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def iban_of(n: Column, country: str = "DE", digits: int = 18) -> Column:
    """An IBAN of an account number, of a country whose accounts are that many digits."""
    from brindle.functions import checksums as ck

    bban = F.lpad(n.cast("string"), digits, "0")
    rest = ck.mod97(F.concat(F.lit(f"{country}00"), bban))
    return F.concat(F.lit(country), F.lpad((98 - rest).cast("string"), 2, "0"), bban)


#: Texts around a planted value, by type: before and after it.
FRAMES = {
    "EMAIL_ADDRESS": ("mail ", " today"), "PHONE_NUMBER": ("call ", " now"), "PAYMENT_CARD": ("card ", " used"), "IP_ADDRESS": ("host ", " up"),
    "IBAN": ("account ", " paid"), "RU_INN": ("inn ", " ok"), "RU_SNILS": ("no ", " end"), "RU_PASSPORT": ("паспорт ", " дан"), "RU_OMS": ("policy ", " kept"),
}


def planted_value(kind: str, n: Column) -> Column:
    two = lambda k, m: ((n / k).cast("bigint") % m).cast("string")
    return {
        "EMAIL_ADDRESS": lambda: F.concat(F.lit("user"), n.cast("string"), F.lit("@mail.example.com")),
        "PHONE_NUMBER": lambda: F.concat(F.lit("+7 9"), F.lpad((n % 100).cast("string"), 2, "0"), F.lit(" "), F.lpad((n % 10_000_000).cast("string"), 7, "1")),
        "PAYMENT_CARD": lambda: card_of(n),
        "IP_ADDRESS": lambda: F.concat_ws(".", F.lit("10"), two(65536, 256), two(256, 256), two(1, 256)),
        "IBAN": lambda: iban_of(n),
        "RU_INN": lambda: inn_of(n),
        "RU_SNILS": lambda: snils_of(n),
        "RU_PASSPORT": lambda: F.concat(F.lit("45 "), F.lpad((n % 100).cast("string"), 2, "0"), F.lit(" "), F.lpad((n % 1_000_000).cast("string"), 6, "0")),
        "RU_OMS": lambda: oms_of(n),
    }[kind]()


def generate_planted(ids: DataFrame, kind: str, column: str = "n") -> DataFrame:
    """ids with type, text, start_utf8 and end_utf8: a text that holds one value of the type with right check digits."""
    before, after = FRAMES[kind]
    value = planted_value(kind, F.col(column))
    start = len(before.encode())
    out = ids.withColumn("type", F.lit(kind)).withColumn("_v", value)
    return out.withColumn("text", F.concat(F.lit(before), "_v", F.lit(after))).withColumn("start_utf8", F.lit(start).cast("bigint")).withColumn("end_utf8", start + F.octet_length("_v").cast("bigint")).drop("_v")


def hard_negatives(ids: DataFrame, kind: str, column: str = "n") -> DataFrame:
    """As generate_planted, with the last digit changed, so that no check digit fits: types with check digits only."""
    out = generate_planted(ids, kind, column)
    last = F.regexp_extract("text", r"([0-9])(?=[^0-9]*\z)", 1)
    return out.withColumn("text", F.regexp_replace("text", F.lit(r"[0-9](?=[^0-9]*\z)"), ((last.cast("int") + 1) % 10).cast("string")))
