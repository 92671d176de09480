"""Queries of the recognizers over planted values in every layout, with near misses that must not be found.

A layout is (before, value, after, evidence): value is an expression that Spark SQL and DuckDB read alike, over the columns
of the planted values; evidence is None for a near miss. The layouts of a type take turns by the number of the order. Check
digits are worked out in Spark by the package's folds and in the SQL on their own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import detect as d
from brindle.plans.catalog import load, query
from brindle.sources import corpora as co

_V, _C, _F = "VALIDATED", "CONTEXTUAL", "FORMAT_ONLY"


def _next(v: str, size: int) -> str:
    """v with its last digit, the size-th, changed."""
    return f"concat(substr({v}, 1, {size - 1}), (cast(substr({v}, {size}, 1) AS int) + 1) % 10)"


def _groups(v: str, sizes: list[int], *separators: str) -> str:
    """v cut to groups of the sizes, joined by the separators."""
    parts, at = [], 1
    for k, n in enumerate(sizes):
        parts += [f"substr({v}, {at}, {n})"] + ([f"'{separators[min(k, len(separators) - 1)]}'"] if k < len(sizes) - 1 else [])
        at += n
    return f"concat({', '.join(parts)})"


_A, _P = "concat('9', lpad(concat(n % 100, ''), 2, '0'))", "lpad(concat(n % 10000000, ''), 7, '1')"
_LINE = (f"substr({_P}, 1, 3)", f"substr({_P}, 4, 2)", f"substr({_P}, 6, 2)")


def _phone(start: str, after_area: str, *rest: str) -> str:
    return f"concat('{start}', {_A}, '{after_area}', {_LINE[0]}, '{rest[0]}', {_LINE[1]}, '{rest[-1]}', {_LINE[2]})"


_IP = "concat(n % 223 + 1, '.', n % 256, '.', n % 7, '.', n % 100)"
_HEX = "lower(hex(n % 65535 + 1))"
_SERIES, _NUMBER = "lpad(concat(n % 100, ''), 2, '0')", "lpad(concat(n % 1000000, ''), 6, '0')"

LAYOUTS = {
    "EMAIL_ADDRESS": [
        ("mail ", "concat('user', n, '@mail.example.com')", " today", _F), ("mail ", "concat('u.', n, ' @ mail . example.com')", " today", _F),
        ("mail ", "concat('.u', n, '@example.com')", " today", None), ("mail ", "concat('u..', n, '@example.com')", " today", None),
        ("mail ", "concat('u', n, '@localhost')", " today", None), ("mail ", "concat('u', n, '@example.com')", ".", None),
        ("почта", "concat('u', n, '@example.com')", " today", None), ("mail ", "concat(repeat('u', 65), n, '@example.com')", " today", None),
        ("mail ", "concat('u', n, '@', repeat('d', 63), '.com')", " today", _F), ("mail ", "concat('u', n, '@', repeat('d', 64), '.com')", " today", None),
        ("mail ", "concat('u', n, '@почта.рф')", ", да", _F), ("mail ", "concat('u', n, '@-x.com')", " today", None), ("<", "concat('a+b', n, '@x-y.org')", ">", _F),
    ],
    "PHONE_NUMBER": [
        ("num ", _phone("+7 ", " ", "-", "-"), " now", _F), ("num ", _phone("8 (", ") ", "-", "-"), " now", _F), ("num ", _phone("8-", "-", "-", "-"), " now", _F),
        ("num ", _phone("+7", "", "", ""), " now", _F), ("num ", _phone("8 ", " ", " ", " "), " now", _F), ("num ", _phone("+7(", ")", "", ""), " now", _F),
        ("phone ", _phone("", " ", " ", " "), " now", _C), ("num ", _phone("8--", "-", "-", "-"), " now", None), ("num ", _phone("8 (", " ", "-", "-"), " now", None),
        ("num ", _phone("", "", "", ""), " now", None), ("", _phone("8‑", "‑", "‑", "‑"), " мой телефон", _F), ("num ", _phone("+7 ", " ", "-", "-"), "-1 now", None),
        ("телефон: ", _phone("7 ", " ", "-", "-"), "!", _C),
    ],
    "PAYMENT_CARD": [
        ("card ", "v", " used", _V), ("card ", _groups("v", [4, 4, 4, 4], " "), " used", _V), ("card ", _groups("v", [4, 4, 4, 4], "-"), ".", _V), ("card ", _next("v", 16), " used", None),
        ("card ", _groups("v", [4, 4, 4, 4], "--"), " used", None), ("card ", "substr(v, 1, 12)", " used", None), ("é", "v", "é", _V), ("card ", "repeat('4', 16)", " used", None),
    ],
    "IP_ADDRESS": [
        ("host ", _IP, " up", _V), ("host ", _IP, ":8080 up", _V), ("host ", _IP, ":70000 up", None), ("host ", _IP, ". End", _V), ("host ", f"concat('0', {_IP})", " up", None),
        ("host ", f"concat({_IP}, '.5')", " up", None), ("host ", f"concat('2001:db8::', {_HEX})", " up", _V), ("host ", f"concat('2001:db8:0:0:0:0:0:', {_HEX})", " up", _V),
        ("host ", f"concat('fe80::', {_HEX})", "%eth0 up", None), ("host ", f"concat('::ffff:', {_IP})", " up", _V), ("host ", f"concat('1:2:3:4:5:6:7:8:', {_HEX})", " up", None),
        ("[", f"concat('2001:DB8::', {_HEX}, ':1')", "]:443", _V),
    ],
    "IBAN": [
        ("account ", "v", " used", _V), ("account ", _groups("v", [4, 4, 4, 4, 4, 2], " "), " paid", _V), ("account ", "lower(v)", " used", _V), ("account ", _next("v", 22), " used", None),
        ("account ", "substr(v, 1, 21)", " used", None), ("account ", _groups("v", [4, 4, 4, 4, 4, 2], "  ", " "), " used", None), ("account ", "w", ", used", _V),
        ("account ", _groups("w", [4, 4, 4, 4], " "), " paid", _V), ("accountx", "v", " used", None), ("account ", "v", "x used", None),
    ],
    "RU_INN": [
        ("inn ", "v", " ok", _V), ("inn 1", "v", " ok", None), ("x", "v", "y", _V), ("inn ", _next("v", 12), " ok", None), ("inn ", "substr(v, 1, 10)", " ok", None), ("№", "v", "/7", _V),
    ],
    "RU_SNILS": [
        ("no ", "v", " end", _V), ("no ", _groups("v", [3, 3, 3, 2], "-", "-", " "), " end", _V), ("no ", _groups("v", [3, 3, 3, 2], "-"), " end", _V), ("no ", _groups("v", [3, 3, 3, 2], " "), " end", _V),
        ("no ", _groups("v", [3, 3, 3, 2], ".", ".", " "), " end", _V), ("no ", _groups("v", [3, 3, 3, 2], "."), " end", None), ("no ", _next("v", 11), " end", None), ("снилс ", _next("v", 11), " end", _C),
        ("снилс" + " " * 40, _next("v", 11), " end", None), ("no 1", "v", " end", None), ("no ", "concat('001001998', lpad(concat(n % 100, ''), 2, '0'))", " снилс", None), ("", _next("v", 11), " это СНИЛС", _C),
    ],
    "RU_PASSPORT": [
        ("паспорт ", f"concat('45', {_SERIES}, ' ', {_NUMBER})", " дан", _C), ("паспорт ", f"concat('45 ', {_SERIES}, ' ', {_NUMBER})", " дан", _C), ("паспорт ", f"concat('45-', {_SERIES}, ' ', {_NUMBER})", " дан", _C),
        ("паспорта ", f"concat('45 ', {_SERIES}, ' № ', {_NUMBER})", " дан", _C), ("серия и номер ", f"concat('45', {_SERIES}, ' ', {_NUMBER})", "", _C), ("серия ", f"concat('45', {_SERIES}, ' ', {_NUMBER})", "", None),
        ("doc ", f"concat('45', {_SERIES}, ' ', {_NUMBER})", " выдан паспортным столом", _C), ("doc ", f"concat('45', {_SERIES}, ' ', {_NUMBER})", " ok", None),
        ("паспорт" + " " * 70, f"concat('45', {_SERIES}, ' ', {_NUMBER})", " дан", None), ("паспорт ", f"concat('45', {_SERIES}, ' ', {_NUMBER}, '7')", " дан", None), ("серия ", f"concat('45', {_SERIES}, ' ', {_NUMBER})", " номер", _C),
    ],
    "RU_OMS": [
        ("policy ", "v", " kept", _V), ("policy ", _groups("v", [4, 4, 4, 4], "-"), " kept", _V), ("policy ", _groups("v", [4, 4, 4, 4], " "), " kept", _V), ("policy ", _groups("v", [4, 4, 4, 4], "-", " ", "-"), " kept", None),
        ("policy ", _next("v", 16), " kept", None), ("омс ", _next("v", 16), " kept", _C), ("полис обязательного медицинского страхования: ", _next("v", 16), "", _C), ("полис медицинского страхования: ", _next("v", 16), "", None),
        ("policy 1", "v", " kept", None), ("омс" + " " * 50, _next("v", 16), " kept", None),
    ],
}

_DIGIT = "lambda w, i: w * substr({d}, i, 1)::INT"


def _weighted(d: str, weights: list[int]) -> str:
    return f"list_sum(list_transform({weights}, {_DIGIT.format(d=d)}))"


#: SQL of the planted values: what n stands for, check digits included.
_INN_11, _INN_12, _SNILS = [7, 2, 4, 10, 3, 5, 9, 4, 6, 8], [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8], [9, 8, 7, 6, 5, 4, 3, 2, 1]
_CARD_SUM = "list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 0 THEN substr(b, i, 1)::INT WHEN substr(b, i, 1)::INT > 4 THEN 2 * substr(b, i, 1)::INT - 9 ELSE 2 * substr(b, i, 1)::INT END))"
_ODD = "(" + " || ".join(f"substr(b, {k}, 1)" for k in range(1, 16, 2)) + ")::BIGINT * 2"
_EVEN = " + ".join(f"substr(b, {k}, 1)::INT" for k in range(2, 15, 2))
_SUM_ODD = f"list_sum(list_transform(string_split(({_ODD})::VARCHAR, ''), lambda x: x::INT))"
VALUES = {
    "PAYMENT_CARD": f"SELECT n, b || (10 - {_CARD_SUM} % 10) % 10 AS v FROM (SELECT n, '4' || lpad(n::VARCHAR, 14, '0') AS b FROM o)",
    "IBAN": "SELECT n, 'DE' || lpad((98 - (b || '131400')::HUGEINT % 97)::VARCHAR, 2, '0') || b AS v, 'BE' || lpad((98 - (c || '111400')::HUGEINT % 97)::VARCHAR, 2, '0') || c AS w FROM (SELECT n, lpad(n::VARCHAR, 18, '0') AS b, lpad(n::VARCHAR, 12, '0') AS c FROM o)",
    "RU_INN": f"SELECT n, e || {_weighted('e', _INN_12)} % 11 % 10 AS v FROM (SELECT n, b || {_weighted('b', _INN_11)} % 11 % 10 AS e FROM (SELECT n, lpad(n::VARCHAR, 10, '1') AS b FROM o))",
    "RU_SNILS": f"SELECT n, b || lpad(({_weighted('b', _SNILS)} % 101 % 100)::VARCHAR, 2, '0') AS v FROM (SELECT n, lpad((n + 100000000)::VARCHAR, 9, '0') AS b FROM o)",
    "RU_OMS": f"SELECT n, b || (10 - ({_SUM_ODD} + {_EVEN}) % 10) % 10 AS v FROM (SELECT n, lpad(n::VARCHAR, 15, '7') AS b FROM o)",
}


def _sql(kind: str) -> str:
    turns = LAYOUTS[kind]
    case = lambda column: " ".join(f"WHEN {k} THEN {column(t)}" for k, t in enumerate(turns))
    quoted = lambda x: "NULL" if x is None else f"'{x}'"
    return (
        f"WITH o AS (SELECT o_orderkey AS n FROM orders), p AS ({VALUES.get(kind, 'SELECT n FROM o')}), "
        f"x AS (SELECT n, CASE n % {len(turns)} {case(lambda t: quoted(t[0]))} END AS b, CASE n % {len(turns)} {case(lambda t: t[1])} END AS v, "
        f"CASE n % {len(turns)} {case(lambda t: quoted(t[3]))} END AS evidence FROM p) "
        "SELECT n, strlen(b)::BIGINT AS start_utf8, (strlen(b) + strlen(v))::BIGINT AS end_utf8, evidence FROM x WHERE evidence IS NOT NULL"
    )


def planted_layouts(spark, sf_dir: str, kind: str):
    """(n, text) of a value of the type for each order, in the layout of its turn."""
    ids = load(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("n"))
    n = F.col("n")
    values = {
        "PAYMENT_CARD": {"v": co.card_of(n)}, "IBAN": {"v": co.iban_of(n), "w": co.iban_of(n, "BE", 12)}, "RU_INN": {"v": co.inn_of(n)},
        "RU_SNILS": {"v": F.regexp_replace(co.snils_of(n), "[^0-9]", "")}, "RU_OMS": {"v": co.oms_of(n)},
    }.get(kind, {})
    turns = LAYOUTS[kind]
    text = F.lit(None).cast("string")
    for k, (before, value, after, _) in enumerate(turns):
        text = F.when(n % len(turns) == k, F.concat(F.lit(before), F.expr(value), F.lit(after))).otherwise(text)
    return ids.withColumns(values).select("n", text.alias("text"))


def _register(name: str, kind: str) -> None:
    def layouts(spark, sf_dir):
        return d.find_type(planted_layouts(spark, sf_dir, kind), kind, ["n"]).select("n", "start_utf8", "end_utf8", "evidence")

    layouts.__name__ = name
    query(_sql(kind))(layouts)


for _k, _kind in enumerate(LAYOUTS, 1):
    _register(f"d{_k}_layouts", _kind)
