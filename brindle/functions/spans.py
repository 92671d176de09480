"""Regex spans with UTF-8 byte offsets, bounded context and interval islands, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FINDING = (
    "array<struct<type:string,start_utf8:bigint,end_utf8:bigint,confidence:double,evidence:string,"
    "recognizer_id:string,recognizer_version:string>>"
)
WORD = r"[\p{L}\p{Nd}_]"


def none_of(kind: str) -> Column:
    return F.array().cast(kind)


#: Items that one inner fold takes: appending to an array copies it, so results are gathered in blocks.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often and however deep in lambdas the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], finish: Callable[[Column], Column] | None = None) -> Column:
    """All rows of step(state, item) -> (next state, array of `kind`), the state carried from item to item, and of
    finish(last state).

    n items cost n * BLOCK / 2 + (n / BLOCK) ** 2 / 2 copied references: linear for any count a text can hold.
    """
    none = none_of(kind)

    def one(acc: Column, x: Column) -> Column:
        after, rows = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], rows).alias("out"))

    def folded(xs: Column) -> Column:
        def block(acc: Column, k: Column) -> Column:
            begin = F.struct(acc["state"].alias("state"), none.alias("out"))
            end = lambda got: F.struct(got["state"].alias("state"), F.concat(acc["out"], F.array(got["out"])).alias("out"))
            return F.aggregate(F.slice(xs, k * BLOCK + 1, F.lit(BLOCK)), begin, one, end)

        blocks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        begin = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        whole = lambda acc: F.concat(F.flatten(acc["out"]), finish(acc["state"])) if finish else F.flatten(acc["out"])
        return F.aggregate(blocks, begin, block, whole)

    return let(items, lambda xs: F.when(F.size(xs) > 0, folded(xs)).otherwise(none))


def matches(text: Column, pattern: str, guard: str | None = None) -> Column:
    """array<struct<m, at, start_utf8, end_utf8>> of a pattern's matches: at is the 0-based code point, the others bytes.

    The texts between matches and the matches are laid end to end in one scan. Texts without a
    match are searched once and skip it, and so do those of one match, whose place is the size of what stands before it: split
    would compile the pattern again for each text, which regexp_replace does not. With a guard, a cheap pattern that every match contains, most texts are
    not searched at all.
    """
    kind = "array<struct<m:string,at:int,start_utf8:bigint,end_utf8:bigint>>"

    def step(place: Column, x: Column) -> tuple[Column, Column]:
        at = place["at"] + F.length(x["g"])
        byte = place["byte"] + F.octet_length(x["g"])
        end = byte + F.octet_length(x["m"])
        one = F.struct(x["m"].alias("m"), at.alias("at"), byte.alias("start_utf8"), end.alias("end_utf8"))
        return F.struct((at + F.length(x["m"])).alias("at"), end.alias("byte")), F.array(one)

    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("byte"))

    def single(found: Column) -> Column:
        before = F.regexp_replace(text, F.lit(rf"(?:{pattern})[\s\S]*"), F.lit(""))
        return let(before, lambda g: step(start, F.struct(F.element_at(found, 1).alias("m"), g.alias("g")))[1])

    def laid(found: Column) -> Column:
        parts = F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("g"))
        return F.when(F.size(found) == 1, single(found)).when(F.size(found) > 1, scan(parts, start, kind, step)).otherwise(none_of(kind))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), laid)
    return F.when(text.rlike(guard), found).otherwise(none_of(kind)) if guard else found


def _windows(text: Column, at: Column, size: Column, n: int) -> tuple[Column, Column]:
    """The n + 1 code points on either side of a span with one code point of the span, spaces at the text's edges."""
    first = F.greatest(at - n, F.lit(0))
    left = F.substring(text, first + 1, at - first + 1)
    left = F.when(at - n - 1 < 0, F.concat(F.lit(" "), left)).otherwise(F.substring(text, at - n, F.lit(n + 2)))
    right = F.concat(F.substring(text, at + size, F.lit(n + 2)), F.lit(" "))
    return left, F.substring(right, F.lit(1), F.lit(n + 2))


def near(text: Column, at: Column, size: Column, n: int, words: str, word: str = WORD) -> Column:
    """Whether a whole word of an alternation lies within n code points of a span, on either side.

    A word cut by the window's far edge does not count: the code point beyond it is seen but never part of a word.
    """
    left, right = _windows(text, at, size, n)
    inside = rf"(?<!{word})(?:{words})(?!{word})"
    return left.rlike(rf"(?isu)\A..*{inside}") | right.rlike(rf"(?isu){inside}(?=.*.\z)")


def prefixed(text: Column, at: Column, size: Column, n: int, words: str, letters: str) -> Column:
    """As near, for words of the letters given that begin with one of an alternation."""
    left, right = _windows(text, at, size, n)
    return left.rlike(rf"(?isu)\A..*(?<!{letters})(?:{words})") | right.rlike(rf"(?isu)(?<!{letters})(?:{words})")


def finding(kind: str, recognizer: str, version: str, m: Column, evidence: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), m["start_utf8"].alias("start_utf8"), m["end_utf8"].alias("end_utf8"),
        F.lit(None).cast("double").alias("confidence"), evidence.alias("evidence"),
        F.lit(recognizer).alias("recognizer_id"), F.lit(version).alias("recognizer_version"),
    )


def findings(found: Column, kind: str, recognizer: str, version: str, evidence: Callable[[Column], Column]) -> Column:
    """Matches with an evidence that is not null, as findings."""
    all_ = F.transform(found, lambda m: finding(kind, recognizer, version, m, evidence(m)))
    return F.filter(all_, lambda f: f["evidence"].isNotNull()).cast(FINDING)


def merge_spans(spans: Column) -> Column:
    """array<struct<start, end, marker>> to its islands: overlapping and adjacent spans become one; an island of
    different markers gets the generic marker."""
    kind = "array<struct<start:bigint,end:bigint,marker:string>>"

    def step(last: Column, s: Column) -> tuple[Column, Column]:
        joined = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
            F.when(last["marker"] == s["marker"], last["marker"]).otherwise(F.lit("[PII_MASKED]")).alias("marker"),
        )
        touch = F.coalesce(s["start"] <= last["end"], F.lit(False))
        return F.when(touch, joined).otherwise(s), F.when(touch | last.isNull(), none_of(kind)).otherwise(F.array(last))

    nothing = F.lit(None).cast(kind[6:-1])
    return scan(F.array_sort(spans.cast(kind)), nothing, kind, step, F.array)
