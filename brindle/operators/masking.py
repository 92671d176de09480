"""Masking: markers, islands of spans, exact rewriting of texts and of cut-up streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions.recognizers import TYPES
from brindle.functions.spans import merge_spans, scan
from brindle.functions.tables import dealt
from brindle.operators.detect import on_boundary

GENERIC = "[PII_MASKED]"
MARKER = r"\A\[[A-Z][A-Z0-9_]*\]\z"


def marker_of(kind: Column) -> Column:
    """The marker of a type; the generic one for others."""
    pairs = [F.lit(x) for n, m, _, _ in TYPES for x in (n, m)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(GENERIC))


def instructions(findings: Column) -> Column:
    """Masking instructions of findings: islands of start, end and marker."""
    return merge_spans(F.transform(findings, lambda f: F.struct(f["start_utf8"].alias("start"), f["end_utf8"].alias("end"), marker_of(f["type"]).alias("marker"))))


def merge_span_rows(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, start, end, marker) to islands by windows: the row form of merge_spans, for groups too large for an array."""
    w = W.partitionBy(*keys).orderBy("start", "end", "marker")
    high = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") > high, F.lit(True)).cast("int")
    out = spans.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w))
    mark = F.when(F.min("marker") == F.max("marker"), F.min("marker")).otherwise(GENERIC)
    return out.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), mark.alias("marker")).drop("_island")


def short_marker(marker: Column, size: Column) -> Column:
    """A marker cut to a span's bytes: *, **, [EMAI]."""
    body = F.concat(F.lit("["), F.substring(marker, F.lit(2), (size - 2).cast("int")), F.lit("]"))
    return F.when(F.length(marker) <= size, marker).when(size == 1, "*").when(size == 2, "**").otherwise(body)


def mask_text(text: Column, spans: Column, fit: bool = False) -> Column:
    """A text with the instructions carried out on its bytes; fit cuts each marker to its span's size."""
    raw = F.encode(text, "UTF-8")
    piece = lambda at, size: F.decode(F.substring(raw, (at + 1).cast("int"), size.cast("int")), "UTF-8")

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        marker = short_marker(s["marker"], s["end"] - s["start"]) if fit else s["marker"]
        return s["end"], F.array(piece(at, s["start"] - at), marker)

    pieces = scan(spans, F.lit(0).cast("bigint"), "array<string>", step, lambda at: F.array(piece(at, F.octet_length(raw))))
    return F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise(text)


def masking_error(text: Column, spans: Column) -> Column:
    """OUT_OF_RANGE, UTF8_BOUNDARY or INVALID_MARKER, the first that holds; null if the instructions fit the text."""
    raw = F.encode(text, "UTF-8")
    size = F.octet_length(raw)
    return (
        F.when(F.exists(spans, lambda s: (s["start"] < 0) | (s["start"] >= s["end"]) | (s["end"] > size)), "OUT_OF_RANGE")
        .when(F.exists(spans, lambda s: ~on_boundary(raw, s["start"]) | ~on_boundary(raw, s["end"])), "UTF8_BOUNDARY")
        .when(F.exists(spans, lambda s: ~s["marker"].rlike(MARKER)), "INVALID_MARKER")
    )


def mask_documents(df: DataFrame, text: str = "text", findings: str = "findings", fit: bool = False) -> DataFrame:
    """df with masked: the text with all findings masked. No shuffle."""
    return df.withColumn("masked", mask_text(F.col(text), instructions(F.col(findings)), fit))


def segment_offsets(deltas: DataFrame, keys: list[str], seq: str = "seq", delta: str = "delta") -> DataFrame:
    """deltas with seg_start and seg_end: bytes of each delta inside its field."""
    w = W.partitionBy(*keys).orderBy(seq)
    size = F.octet_length(F.col(delta)).cast("bigint")
    before = F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    return deltas.withColumn("seg_start", before).withColumn("seg_end", before + size)


def mask_deltas(deltas: DataFrame, islands: DataFrame, keys: list[str], seq: str = "seq", delta: str = "delta") -> DataFrame:
    """Deltas with the islands (keys, start, end, marker) of their joined field carried out: masked_delta.

    The marker goes to the delta that holds the island's start; covered text leaves the others, which stay, if empty
    then as "". An interval join inside a field, one group of parts for each delta.
    """
    seg = segment_offsets(deltas, keys, seq, delta)
    spans = islands.select(*keys, F.struct("start", "end", "marker").alias("island"))
    overlap = (F.col("seg_end") > F.col("island.start")) & (F.col("seg_start") < F.col("island.end"))
    s = seg.alias("s").join(spans.alias("i"), [F.col(f"s.{k}") == F.col(f"i.{k}") for k in keys] + [overlap], "left")
    same = F.struct(
        F.greatest(F.col("island.start") - F.col("seg_start"), F.lit(0)).alias("start"),
        (F.least(F.col("island.end"), F.col("seg_end")) - F.col("seg_start")).alias("end"),
        F.when(F.col("island.start") >= F.col("seg_start"), F.col("island.marker")).otherwise("").alias("marker"),
    )
    cuts = F.array_sort(F.collect_list(F.when(F.col("island").isNotNull(), same)))
    out = s.groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], F.col(f"s.{seq}").alias(seq), F.col(f"s.{delta}").alias(delta), "seg_start", "seg_end").agg(cuts.alias("_cuts"))
    return out.withColumn("masked_delta", mask_text(F.col(delta), F.col("_cuts"))).drop("_cuts")


def check_patches(patches: DataFrame, keys: list[str]) -> DataFrame:
    """A row a document with error_code of its patch plan (ordinal, locator, start, end): DUPLICATE_ORDINAL,
    DUPLICATE_LOCATOR, OVERLAP, or null."""
    # One window marks repeats as well: counting different ordinals and locators would move each row twice more.
    own = W.partitionBy(*keys)
    again = lambda c: F.coalesce(F.row_number().over(own.orderBy(c)) - F.rank().over(own.orderBy(c)) > 0, F.lit(False)) | F.col(c).isNull()
    marked = dealt(patches.select(*keys, "ordinal", "locator", "start", "end"), patches.count(), *keys).select(
        *keys, again("ordinal").alias("_ordinal"), again("locator").alias("_locator"),
        F.coalesce(F.lag("end").over(own.orderBy("start", "end")) > F.col("start"), F.lit(False)).alias("_bad"),
    )
    code = F.when(F.bool_or("_ordinal"), "DUPLICATE_ORDINAL").when(F.bool_or("_locator"), "DUPLICATE_LOCATOR").when(F.bool_or("_bad"), "OVERLAP")
    return marked.groupBy(*keys).agg(code.alias("error_code"))


def rebuild_json(df: DataFrame, columns: dict[str, str], to: str = "body") -> DataFrame:
    """df with a JSON document of the named columns, equal in value (not byte by byte) to the original."""
    return df.withColumn(to, F.to_json(F.struct(*[F.col(c).alias(n) for n, c in columns.items()])))
