"""Detection over tables of texts: preflight, all recognizers in canonical order, large documents in windows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.recognizers import FINDERS, NAMES, TYPES
from brindle.functions.spans import FINDING, none_of
from brindle.functions.tables import saved

#: Largest text of one call, in UTF-8 bytes; larger ones go through chunk_documents.
MAX_BYTES = 1_048_576


def preflight(df: DataFrame, text: str = "text", limit: int = MAX_BYTES) -> DataFrame:
    """df with size_utf8 and error_code: INVALID_UNICODE before PAYLOAD_TOO_LARGE, null if neither."""
    size = F.octet_length(F.col(text))
    code = F.when(~F.is_valid_utf8(F.col(text)), "INVALID_UNICODE").when(size > limit, "PAYLOAD_TOO_LARGE")
    return df.withColumn("size_utf8", size.cast("bigint")).withColumn("error_code", code)


def type_order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, NAMES)), kind)


def all_findings(text: Column, types: Iterable[str] = NAMES) -> Column:
    """Findings of the enabled types in canonical order: type, start, end, recognizer; exact duplicates removed."""
    chosen = set(types)
    parts = [F.array_sort(F.array_distinct(FINDERS[n](text))) for n in NAMES if n in chosen]
    return F.coalesce(F.concat(*parts), none_of(FINDING)) if parts else none_of(FINDING)


def first_finding(text: Column, types: Iterable[str] = NAMES) -> Column:
    """The first finding of the first type that has one, in canonical order; later types are not evaluated."""
    chosen = set(types)
    each = [F.try_element_at(F.array_sort(FINDERS[n](text)), F.lit(1)) for n in NAMES if n in chosen]
    return F.coalesce(*each) if each else F.lit(None).cast(FINDING[6:-1])


def detect_pii(df: DataFrame, text: str = "text", types: Iterable[str] = NAMES, stop_on_first: bool = False, limit: int = MAX_BYTES) -> DataFrame:
    """df with error_code and findings; one scan, no shuffle. No type enabled: no findings and no preflight."""
    types = tuple(types)
    if not types:
        return df.withColumn("error_code", F.lit(None).cast("string")).withColumn("findings", none_of(FINDING))
    out = preflight(df, text, limit).drop("size_utf8")
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.array_compact(F.array(first_finding(t, types))).cast(FINDING) if stop_on_first else all_findings(t, types)
    return out.withColumn("findings", F.when(F.col("error_code").isNull(), found))


def findings_of(df: DataFrame, keys: list[str], column: str = "findings") -> DataFrame:
    """A row for each finding, without the text."""
    return df.select(*keys, F.inline(column))


def find_type(df: DataFrame, kind: str, keys: list[str], text: str = "text") -> DataFrame:
    """Findings of one type as rows."""
    return df.select(*keys, F.inline(FINDERS[kind](F.coalesce(F.col(text), F.lit("")))))


def pii_types(spark) -> DataFrame:
    """The dimension of types: order, marker, recognizer and version."""
    rows = [(n, k, m, r, v) for k, (n, m, r, v) in enumerate(TYPES, 1)]
    return spark.createDataFrame(rows, "type string, type_order int, marker string, recognizer_id string, recognizer_version string")


#: User-supplied detectors: name -> function from a text column to an array of findings.
_DETECTORS: dict[str, Callable[[Column], Column]] = {"fast-pii": all_findings}


def register_detector(name: str, function: Callable[[Column], Column]) -> None:
    if not name.strip():
        raise ValueError("a detector needs a name")
    _DETECTORS[name] = function


def run_detectors(df: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """A row for each row and detector: detector_id, status CLEAN, DETECTED or ERROR, error_code, findings.

    Unknown detectors give UNKNOWN_DETECTOR; findings that are not valid spans of the text, in order, give
    INVALID_DETECTOR_RESULT.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    results = []
    for n in names:
        known = n in _DETECTORS
        found = _DETECTORS[n](t).cast(FINDING) if known else none_of(FINDING)
        results.append(F.struct(F.lit(n).alias("detector_id"), F.lit(known).alias("known"), found.alias("findings")))
    out = df.withColumn("_d", F.explode(F.array(*results)))
    valid = valid_findings(F.col("_d.findings"), F.col(text))
    code = F.when(~F.col("_d.known"), "UNKNOWN_DETECTOR").when(~valid, "INVALID_DETECTOR_RESULT")
    status = F.when(code.isNotNull(), "ERROR").when(F.size("_d.findings") > 0, "DETECTED").otherwise("CLEAN")
    return out.select(
        *df.columns, F.col("_d.detector_id").alias("detector_id"), status.alias("status"), code.alias("error_code"),
        F.when(code.isNull(), F.col("_d.findings")).otherwise(none_of(FINDING)).alias("findings"),
    )


def on_boundary(raw: Column, at: Column) -> Column:
    """Whether a byte offset of UTF-8 binary stands between two characters."""
    byte = F.conv(F.hex(F.substring(raw, at.cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (at >= F.octet_length(raw)) | ~byte.between(128, 191)


def valid_findings(found: Column, text: Column) -> Column:
    """Spans not empty, inside the text, on character boundaries; confidence in [0, 1]; a type; canonical order."""
    raw = F.encode(text, "UTF-8")
    each = F.forall(
        found,
        lambda f: (f["start_utf8"] >= 0) & (f["start_utf8"] < f["end_utf8"]) & (f["end_utf8"] <= F.octet_length(raw))
        & on_boundary(raw, f["start_utf8"]) & on_boundary(raw, f["end_utf8"])
        & F.coalesce(f["confidence"].between(0, 1), F.lit(True)) & (F.length(F.trim(f["type"])) > 0),
    )
    key = lambda f: F.struct(F.coalesce(type_order(f["type"]), F.lit(0)), f["start_utf8"], f["end_utf8"], f["recognizer_id"])
    keys = F.transform(found, key)
    return each & (keys == F.array_sort(keys))


def annotate_url_hosts(df: DataFrame, text: str, start: str, end: str) -> DataFrame:
    """df with host_start and host_end: bytes of an IP-literal host inside an annotated URL span, or of an annotated
    IPv4:port without its port; null where there is none."""
    raw = F.encode(F.col(text), "UTF-8")
    value = F.decode(F.substring(raw, F.col(start).cast("int") + 1, (F.col(end) - F.col(start)).cast("int")), "UTF-8")
    host = F.coalesce(F.try_parse_url(value, F.lit("HOST")), F.nullif(F.regexp_extract(value, r"\A((?:[0-9]{1,3}\.){3}[0-9]{1,3}):[0-9]{1,5}\z", 1), F.lit("")))
    bare = F.regexp_replace(host, r"[\[\]]", "")
    ok = F.size(F.filter(FINDERS["IP_ADDRESS"](bare), lambda f: (f["start_utf8"] == 0) & (f["end_utf8"] == F.octet_length(bare)))) > 0
    at = F.when(ok, F.col(start) + F.octet_length(F.left(value, F.call_function("locate", bare, value) - 1)))
    return df.withColumn("host_start", at).withColumn("host_end", at + F.octet_length(bare))


# ------------------------------------------------------------------ large documents


def check_windowing(window: int, entity: int | None, version: str = "1") -> str | None:
    """The reason why a window and a largest entity cannot be used together, or None."""
    if not version.strip() or window <= 0:
        return "INVALID_CAPABILITY"
    if entity is not None and (not 0 < entity <= window or window - 2 * (entity - 1) < 4):
        return "INVALID_CAPABILITY"
    return None


def windowing_error(size: Column, window: Column, entity: Column, version: Column) -> Column:
    """check_windowing for rows that bring their own capability, and WINDOWING_UNSUPPORTED for a text above its window where
    no largest entity is known; null if the text can be inspected. A capability without window or version is invalid."""
    fits = entity.isNull() | ((entity > 0) & (entity <= window) & (window - 2 * (entity - 1) >= 4))
    valid = F.coalesce((F.length(F.trim(version)) > 0) & (window > 0) & fits, F.lit(False))
    return F.when(~valid, "INVALID_CAPABILITY").when(entity.isNull() & (size > window), "WINDOWING_UNSUPPORTED")


def chunk_documents(df: DataFrame, text: str = "text", window: int = MAX_BYTES, entity: int = 4096) -> DataFrame:
    """A row for each window of a text: window_start, core_start, core_end (bytes) and chunk, the window's text.

    Cores own the findings that start in them; a window adds entity - 1 bytes of context on each side. No cut falls
    inside a character. One huge row becomes many rows, which later shuffles and tasks share.
    """
    if reason := check_windowing(window, entity):
        raise ValueError(reason)
    core = window - 2 * (entity - 1)
    raw = F.encode(F.col(text), "UTF-8")
    whole = F.col("_size") <= window
    out = df.withColumn("_raw", raw).withColumn("_size", F.octet_length("_raw").cast("bigint"))

    def back(at: Column) -> Column:
        tail = [F.when(on_boundary(F.col("_raw"), at - k), at - k) for k in range(4)]
        return F.coalesce(*tail)

    starts = F.when(whole, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("_size") - 1, F.lit(core).cast("bigint")))
    out = out.withColumn("_at", F.explode(starts))
    out = out.withColumn("core_start", F.when(F.col("_at") == 0, F.lit(0).cast("bigint")).otherwise(back(F.col("_at"))))
    next_ = F.col("_at") + core
    out = out.withColumn("core_end", F.when(whole | (next_ >= F.col("_size")), F.col("_size")).otherwise(back(next_)))
    out = out.withColumn("window_start", back(F.greatest(F.col("core_start") - (entity - 1), F.lit(0).cast("bigint"))))
    stop = F.least(F.col("core_end") + (entity - 1), F.col("_size"))
    piece = F.substring(F.col("_raw"), (F.col("window_start") + 1).cast("int"), (back(stop) - F.col("window_start")).cast("int"))
    return out.withColumn("chunk", F.decode(piece, "UTF-8")).select(*df.columns, "window_start", "core_start", "core_end", "chunk")


def detect_windowed(df: DataFrame, keys: list[str], text: str = "text", types: Iterable[str] = NAMES, window: int = MAX_BYTES, entity: int = 4096) -> DataFrame:
    """Findings of texts of any size: (keys, error_code, findings) in the order start, end, type, recognizer.

    Spans are moved to the text, kept by the core that owns their start and united; equal spans with different
    metadata are INCONSISTENT_WINDOW_RESULT, and a text with an error has no findings.
    """
    chunks = chunk_documents(df.select(*keys, text), text, window, entity)
    return _united(chunks.withColumn("_found", all_findings(F.col("chunk"), types)), keys)


def _united(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of windows (keys, window_start, core_start, core_end, _found) as those of their texts."""
    found = chunks.select(*keys, "window_start", "core_start", "core_end", F.explode_outer("_found").alias("f"))
    moved = found.withColumn("start_utf8", F.col("f.start_utf8") + F.col("window_start")).withColumn("end_utf8", F.col("f.end_utf8") + F.col("window_start"))
    owned = F.col("f").isNotNull() & (F.col("start_utf8") >= F.col("core_start")) & (F.col("start_utf8") < F.col("core_end"))
    one = F.when(owned, F.struct("start_utf8", "end_utf8", F.col("f.type").alias("type"), F.col("f.recognizer_id").alias("recognizer_id"), F.col("f.recognizer_version").alias("recognizer_version"), F.col("f.evidence").alias("evidence")))
    all_ = moved.withColumn("_one", one).groupBy(*keys).agg(F.array_sort(F.collect_set("_one")).alias("_all"))
    name = lambda x: F.struct(x["start_utf8"], x["end_utf8"], x["type"], x["recognizer_id"])
    clash = F.size(F.array_distinct(F.transform("_all", name))) < F.size("_all")
    rows = F.transform("_all", lambda x: F.struct(
        x["type"].alias("type"), x["start_utf8"].alias("start_utf8"), x["end_utf8"].alias("end_utf8"), F.lit(None).cast("double").alias("confidence"),
        x["evidence"].alias("evidence"), x["recognizer_id"].alias("recognizer_id"), x["recognizer_version"].alias("recognizer_version")))
    return all_.select(
        *keys, F.when(clash, "INCONSISTENT_WINDOW_RESULT").alias("error_code"), F.when(~clash, rows.cast(FINDING)).alias("findings")
    )


def detect_any_size(df: DataFrame, text: str = "text", types: Iterable[str] = NAMES, limit: int = MAX_BYTES, entity: int = 4096) -> DataFrame:
    """As detect_pii, without PAYLOAD_TOO_LARGE: texts above the limit go through windows of that size, in canonical order."""
    types = tuple(types)
    if not types:
        return detect_pii(df, text, types)
    large = F.coalesce((F.octet_length(F.col(text)) > limit) & F.is_valid_utf8(F.col(text)), F.lit(False))
    rows = saved(df.where(large).withColumn("_id", F.monotonically_increasing_id()), "large")
    # The expression of all types is large: it is built once, for whole texts and windows named alike.
    found_in_chunk = all_findings(F.coalesce("chunk", F.lit("")), types)
    small = preflight(df.where(~large), text, limit).withColumn("chunk", F.col(text))
    small = small.select(*df.columns, "error_code", F.when(F.col("error_code").isNull(), found_in_chunk).alias("findings"))
    found = _united(chunk_documents(rows, text, limit, entity).withColumn("_found", found_in_chunk), ["_id"])
    ranked = F.array_sort(F.transform("findings", lambda f: F.struct(type_order(f["type"]).alias("k"), f.alias("f"))))
    found = found.select("_id", "error_code", F.transform(ranked, lambda x: x["f"]).cast(FINDING).alias("findings"))
    return small.unionByName(rows.join(found, "_id").drop("_id"))


def reconcile_windows(found: DataFrame, keys: list[str], window_key: str = "window_error") -> DataFrame:
    """Per-window findings with owner columns to one result a document: an error of any window is the document's."""
    error = F.min(window_key)
    kept = F.col("start_utf8").isNotNull() & (F.col("start_utf8") >= F.col("core_start")) & (F.col("start_utf8") < F.col("core_end"))
    span = F.when(kept, F.struct("start_utf8", "end_utf8", "type", "recognizer_id"))
    out = found.groupBy(*keys).agg(error.alias("error_code"), F.array_sort(F.collect_set(span)).alias("spans"))
    return out.withColumn("spans", F.when(F.col("error_code").isNull(), F.col("spans")))
