"""Check digits as Catalyst folds over strings of ASCII digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    """array<int> of the digits of a string; other characters are left out."""
    return F.transform(F.split(F.regexp_replace(value, r"[^0-9]", ""), ""), lambda c: c.cast("int"))


def weighted(value: Column, weights: list[int]) -> Column:
    """Sum of the first digits times the weights."""
    parts = F.zip_with(F.slice(digits(value), 1, len(weights)), F.array(*map(F.lit, weights)), lambda a, b: a * b)
    return F.aggregate(parts, F.lit(0), lambda acc, x: acc + x)


def digit(value: Column, place: int) -> Column:
    return F.substring(value, place, 1).cast("int")


def one_digit_repeated(value: Column) -> Column:
    return value.rlike(r"\A([0-9])\1*\z")


def luhn(value: Column) -> Column:
    return F.call_function("luhn_check", value)


#: Weights of the check digits (fixed values).
INN_11 = [7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
INN_12 = [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
SNILS = [9, 8, 7, 6, 5, 4, 3, 2, 1]


def inn_person(value: Column) -> Column:
    """Twelve digits whose last two check."""
    first = weighted(value, INN_11) % 11 % 10 == digit(value, 11)
    return first & (weighted(value, INN_12) % 11 % 10 == digit(value, 12))


def snils_check(value: Column) -> Column:
    """Two-digit check number of nine digits."""
    k = weighted(value, SNILS) % 101
    return F.lpad(F.when(k == 100, 0).otherwise(k).cast("string"), 2, "0")


def snils(value: Column) -> Column:
    return F.substring(value, 10, 2) == snils_check(value)


def oms_check(value: Column) -> Column:
    """Check digit of fifteen digits: the number of the odd places from the right is doubled as a whole, with carries;
    the digits of that number and of the even places are summed."""
    d = F.reverse(F.slice(digits(value), 1, 15))
    odd = F.filter(d, lambda x, i: i % 2 == 0)
    even = F.aggregate(F.filter(d, lambda x, i: i % 2 == 1), F.lit(0), lambda a, x: a + x)
    # the digits come from the lowest up, so a carry goes to the next one
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("carry"))
    doubled = F.aggregate(
        odd,
        start,
        lambda a, x: F.struct(
            (a["sum"] + (2 * x + a["carry"]) % 10).alias("sum"), F.floor((2 * x + a["carry"]) / 10).cast("int").alias("carry")
        ),
        lambda a: a["sum"] + a["carry"],
    )
    return F.pmod(10 - (doubled + even) % 10, F.lit(10))


def oms(value: Column) -> Column:
    return digit(value, 16) == oms_check(value)


#: Length of an IBAN by country: SWIFT registry, release 102 (fixed values).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
    "YE": 30,
}


def iban_length(country: Column) -> Column:
    pairs = [F.lit(x) for item in IBAN_LENGTHS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.upper(country))


def mod97(compact: Column) -> Column:
    """Remainder of an upper-case IBAN, its first four characters moved to the end, letters as 10 to 35."""
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))
    digit_ = lambda c: F.ascii(c) < 58
    return F.aggregate(
        F.split(turned, ""), F.lit(0), lambda a, c: F.when(digit_(c), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    )
