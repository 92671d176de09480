"""Secret scans with DataFrame functions only: base patterns, and sliding-window entropy of candidate strings."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.spans import let, none_of, scan
from brindle.llm.common import without

#: Base patterns, in the order in which kinds of one start are listed (fixed values).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "entropy")
#: Candidates of the entropy scan: runs of at least WINDOW characters of the base64 alphabets.
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}+={0,2}"
#: Least bits per character of the best window, by character class: (name, pattern of the whole candidate, bits).
CLASSES = (("digits", r"^[0-9]+$", None), ("hex", r"^[0-9a-fA-F]+$", 3.0), ("base64", r"", 3.75))
#: Repeats of groups are possessive: Java then loops instead of recursing, so no token is too long.
#: What is not a secret however mixed it looks: UUIDs, words, joined words and paths, identifiers, runs of the
#: alphabet, digests that name an algorithm, and the example keys of public manuals.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[^0-9]+$",
    r"^[A-Za-z]++(?:[/_-]++[A-Za-z]++)*+[/_-]?[0-9]{0,4}$",
    r"(?i)abcdefghij|0123456789|9876543210|qwertyuiop",
    r"(?i)^(?:sha|md)[0-9]+[-_/]",
    r"(?i)example",
)

SPANS = "array<struct<start:int,rank:int,end:int>>"
#: The ASCII characters of candidates lie between these two. The entropy fold carries the counts of a window as a string
#: with one place for each of them, whose character is NONE moved up by the count.
FIRST, LAST, NONE = ord("+"), ord("z"), ord("0")


def _fold(text: Column, pattern: str, rank: int, keep=None, group: int | None = None) -> Column:
    """Spans of the matches of a pattern: the texts between matches and the matches, laid end to end in code points."""
    p = F.lit(pattern)
    none = none_of(SPANS)

    def parts(m: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        return F.arrays_zip(m.alias("m"), gaps.alias("g"), (F.regexp_extract_all(text, p, F.lit(group)) if group else m).alias("v"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        return end, F.when(keep(x["v"]), span).otherwise(none) if keep else span

    found = scan(let(F.regexp_extract_all(text, p, F.lit(0)), parts), F.lit(0), SPANS, step)
    return F.when(text.rlike(pattern), found).otherwise(none)


def _count(counts: Column, c: Column) -> Column:
    """The count at place c."""
    return F.ascii(F.substring(counts, c, F.lit(1))) - NONE


def _added(counts: Column, c: Column, n: Column) -> Column:
    """counts with n at place c."""
    return F.overlay(counts, F.char(n + NONE), c, F.lit(1))


def best_entropy(token: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits per character, of a window of that many characters in a token.

    The counts n of the window's characters (ASCII, from + to z) and the sum of n log2 n over them are carried along
    the token: a step adds what the entering character changes and takes off what the leaving one does. Tokens shorter
    than the window have 0.
    """
    weight = [n * math.log2(n) if n else 0.0 for n in range(window + 2)]
    gains = F.array(*[F.lit(y - x) for x, y in itertools.pairwise(weight)])  # of a character that is there 0, 1, ... times
    gain = lambda n: F.element_at(gains, (n + 1).cast("int"))

    def enter(acc: Column, c: Column) -> Column:
        n = _count(acc["counts"], c)
        return F.struct((acc["sum"] + gain(n)).alias("sum"), _added(acc["counts"], c, n + 1).alias("counts"))

    def slid(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new, old = F.element_at(codes, i), F.element_at(codes, i - window)
            n, m = _count(acc["counts"], new), _count(acc["counts"], old)
            total = acc["sum"] + gain(n) - gain(m - 1)
            counts = _added(_added(acc["counts"], new, n + 1), old, m - 1)
            after = F.struct(total.alias("sum"), counts.alias("counts"), F.least(acc["least"], total).alias("least"))
            return F.when(new == old, acc).otherwise(after)

        none = F.struct(F.lit(0.0).alias("sum"), F.lit(chr(NONE) * (LAST - FIRST + 1)).alias("counts"))
        first = F.aggregate(F.slice(codes, 1, window), none, enter, lambda a: F.struct(a["sum"].alias("sum"), a["counts"].alias("counts"), a["sum"].alias("least")))
        rest = F.when(F.size(codes) > window, F.sequence(F.lit(window + 1), F.size(codes))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(rest, first, step, lambda acc: F.lit(math.log2(window)) - acc["least"] / window)

    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - (FIRST - 1))
    return F.when(F.length(token) < window, F.lit(0.0)).otherwise(let(codes, slid))


def _secretive(token: Column) -> Column:
    """Whether a candidate is not allowed and a window of it reaches the bits of its character class."""
    allowed = F.lit(False)
    for a in ALLOWED:
        allowed = allowed | token.rlike(a)
    bits = best_entropy(token)
    enough = F.lit(False)
    for _, pattern, least in reversed(CLASSES):
        test = F.lit(False) if least is None else bits >= least
        enough = F.when(token.rlike(pattern), test).otherwise(enough) if pattern else test
    return F.when(allowed, F.lit(False)).otherwise(enough)


def _uncovered(base: Column, more: Column) -> Column:
    """base and those of more that no span of base covers, in order: the furthest end of base so far is carried."""
    none = none_of(SPANS)

    def step(end: Column, s: Column) -> tuple[Column, Column]:
        known = s["rank"] < KINDS.index("entropy")
        return F.when(known, F.greatest(end, s["end"])).otherwise(end), F.when(known | (s["end"] > end), F.array(s)).otherwise(none)

    return F.when(F.size(more) == 0, base).otherwise(scan(F.array_sort(F.concat(base, more)), F.lit(0), SPANS, step))


def _join(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def scan_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_assign, n_access, n_hex, base_spans and spans.

    Spans are kind:start:end in code points, end exclusive, ordered by start, then by KINDS, comma-joined. base_spans
    holds the matches of the three base patterns, leftmost and non-overlapping for each kind; spans adds candidates
    of high entropy that are not on the allow-list, unless a base span covers them. Null and empty texts have none.
    Input columns of those names are replaced, others pass through; there is no shuffle and no Python.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = without(df, "n_assign", "n_access", "n_hex", "base_spans", "spans")
    names = out.columns
    out = out.withColumn("_base", F.array_sort(F.concat(
        _fold(t, ASSIGN, 0, lambda v: F.length(v) >= 6, 2), _fold(t, ACCESS, 1), _fold(t, HEX, 2)
    )))
    out = out.withColumn("_more", _fold(t, CANDIDATE, 3, _secretive))
    base = F.col("_base")
    count = lambda k: F.size(F.filter(base, lambda s: s["rank"] == k)).cast("long")
    return out.select(
        *names, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        _join(base).alias("base_spans"), _join(_uncovered(base, F.col("_more"))).alias("spans"),
    )


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan_secrets(docs)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
