"""Recognizers of sensitive values: a text column to an array of findings. All of it runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import checksums as ck
from brindle.functions.spans import FINDING, finding, findings, matches, near, none_of, prefixed

#: Types in their canonical order with markers and recognizers (fixed values).
TYPES = (
    ("EMAIL_ADDRESS", "[EMAIL_MASKED]", "fast.email_address", "1.1.0"),
    ("PHONE_NUMBER", "[PHONE_MASKED]", "fast.phone_number.ru", "1.1.0"),
    ("PAYMENT_CARD", "[CARD_MASKED]", "fast.payment_card.luhn", "1.0.0"),
    ("IP_ADDRESS", "[IP_MASKED]", "fast.ip_address", "1.2.0"),
    ("IBAN", "[IBAN_MASKED]", "fast.iban", "1.0.0+iban-registry.102"),
    ("RU_INN", "[INN_MASKED]", "fast.ru_inn", "1.0.0"),
    ("RU_SNILS", "[SNILS_MASKED]", "fast.ru_snils", "1.1.0"),
    ("RU_PASSPORT", "[PASSPORT_MASKED]", "fast.ru_passport", "1.0.0"),
    ("RU_OMS", "[OMS_MASKED]", "fast.ru_oms", "1.1.0"),
)
NAMES = tuple(t[0] for t in TYPES)
INFO = {t[0]: t for t in TYPES}

VALIDATED, CONTEXTUAL, FORMAT_ONLY = "VALIDATED", "CONTEXTUAL", "FORMAT_ONLY"


def _found(kind: str, found: Column, evidence) -> Column:
    return findings(found, kind, INFO[kind][2], INFO[kind][3], evidence)


def _if(test: Column, evidence: str) -> Column:
    return F.when(test, F.lit(evidence))


_LOCAL = r"A-Za-z0-9!#$%&'*+/=?^_`{|}~.\-"
_SYMBOL = r"!#$%&'*+/=?^_`{|}~.\-"
_LABEL = r"[\p{L}\p{M}\p{Nd}\-]++"
_DOT = r"[.。．｡]"
EMAIL = (
    rf"(?<![{_LOCAL}\p{{L}}\p{{M}}\p{{Nd}}])(?<![{_SYMBOL}] {{1,32}})[{_LOCAL}]++ {{0,3}}@ {{0,3}}"
    rf"{_LABEL}(?: {{0,3}}{_DOT} {{0,3}}{_LABEL})*+(?! *{_DOT})(?![\p{{L}}\p{{M}}\p{{Nd}}\-])"
)


def find_email(text: Column) -> Column:
    """Local parts of 1 to 64 characters at domains of two labels or more; up to three spaces around @ and dots.

    The labels of domains outside ASCII are checked by code points, before any conversion.
    """

    def evidence(m: Column) -> Column:
        local = F.rtrim(F.substring_index(m["m"], "@", 1))
        domain = F.regexp_replace(F.substring_index(m["m"], "@", -1), r" +", "")
        domain = F.regexp_replace(domain, _DOT, ".")
        short = (F.length(local) <= 64) & (F.length(local) + 1 + F.length(domain) <= 254)
        ok = ~local.rlike(r"\A\.|\.\z|\.\.") & domain.rlike(r"\A(?![\-])[^.]{1,63}(?<![\-])(?:\.(?![\-])[^.]{1,63}(?<![\-]))++\z")
        return F.when(short, _if(ok, FORMAT_ONLY))

    return F.when(F.contains(text, F.lit("@")), _found("EMAIL_ADDRESS", matches(text, EMAIL), evidence)).otherwise(none_of(FINDING))


_SEP = r"[ \-  ‐‑–]"
_D = "[0-9]"
PHONE = (
    rf"(?<![0-9+)(])(?<![0-9]{_SEP})(?<![0-9][.:/])(?:\+7{_SEP}?|[78]{_SEP}?)?"
    rf"(?:\({_D}(?:{_SEP}?{_D}){{2}}\){_SEP}?{_D}(?:{_SEP}?{_D}){{6}}|{_D}(?:{_SEP}?{_D}){{9}})"
    rf"(?![0-9()])(?!{_SEP}[0-9()])(?!{_SEP}{{2,}}[0-9])(?![.:/][0-9])"
)
#: Words of a phone number nearby (fixed values).
PHONE_WORDS = "телефон|тел|мобильный|моб|phone|contact"


def find_phone_ru(text: Column) -> Column:
    """+7 or 8 and ten digits; ten digits, or eleven after 7, only near a word for phone."""

    def evidence(m: Column) -> Column:
        d = F.regexp_replace(m["m"], "[^0-9]", "")
        plain = (F.length(d) == 11) & (m["m"].startswith("+") | d.startswith("8"))
        context = near(text, m["at"], F.length(m["m"]), 32, PHONE_WORDS)
        return F.when(plain, F.lit(FORMAT_ONLY)).when(context, F.lit(CONTEXTUAL))

    return _found("PHONE_NUMBER", matches(text, PHONE, "[0-9]"), evidence)


CARD = r"[0-9][0-9 \-]*+"


def find_payment_card(text: Column) -> Column:
    """Runs of 13 to 19 digits with single spaces or hyphens that pass Luhn's check."""

    def trimmed(m: Column) -> Column:
        run = F.rtrim(m["m"])
        return F.struct(run.alias("m"), m["at"].alias("at"), m["start_utf8"].alias("start_utf8"), (m["start_utf8"] + F.length(run)).alias("end_utf8"))

    def evidence(m: Column) -> Column:
        d = F.regexp_replace(m["m"], "[^0-9]", "")
        shape = m["m"].rlike(r"\A[0-9](?:[ \-]?[0-9]){12,18}\z") & ~ck.one_digit_repeated(d)
        return F.when(shape, _if(ck.luhn(d), VALIDATED))

    runs = F.transform(F.filter(matches(text, CARD), lambda m: F.length(m["m"]) >= 13), trimmed)
    return F.when(text.rlike(r"[0-9][0-9 \-]{11,}[0-9]"), _found("PAYMENT_CARD", runs, evidence)).otherwise(none_of(FINDING))


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_PORT = r"0*(?:6553[0-5]|655[0-2][0-9]|65[0-4][0-9]{2}|6[0-4][0-9]{3}|[1-5][0-9]{4}|[1-9][0-9]{0,3})"
IPV4 = (
    rf"(?<![A-Za-z0-9.:]){_V4}(?![A-Za-z0-9])"
    rf"(?:(?![.:])|(?=\.(?![A-Za-z0-9.:]))|(?=:(?![A-Za-z0-9.:_%]|[+\-][0-9]))"
    rf"|(?=:(?![0-9]{{6}}){_PORT}(?![A-Za-z0-9.:_%])))"
)
#: Characters of the longest IPv6 text, with an IPv4 tail; longer runs are not matched further.
LONGEST_IPV6 = 45
IPV6 = r"(?<![0-9A-Fa-f:])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:][0-9A-Fa-f:.]*+(?!%)"


def find_ip(text: Column) -> Column:
    """Strict IPv4 and IPv6 addresses; a port or one closing dot or colon is left out of the span."""
    four = _found("IP_ADDRESS", matches(text, IPV4), lambda m: F.lit(VALIDATED))

    def trimmed(m: Column) -> Column:
        run = F.regexp_replace(m["m"], r"(?<![:.])[.:]\z|(?<=::)\.\z", "")
        return F.struct(run.alias("m"), m["at"].alias("at"), m["start_utf8"].alias("start_utf8"), (m["start_utf8"] + F.length(run)).alias("end_utf8"))

    def evidence(m: Column) -> Column:
        plain = F.regexp_replace(m["m"], rf"(?<=:){_V4}\z", "0:0")
        units = F.size(F.filter(F.split(plain, ":"), lambda u: u != ""))
        unit = "[0-9A-Fa-f]{1,4}"
        full = plain.rlike(rf"\A(?:{unit}:){{7}}{unit}\z")
        short = plain.rlike(rf"\A(?:{unit}(?::{unit})*)?::(?:{unit}(?::{unit})*)?\z") & (units < 8)
        return F.when(F.length(m["m"]) <= LONGEST_IPV6, _if(full | short, VALIDATED))

    six = _found("IP_ADDRESS", F.transform(matches(text, IPV6), trimmed), evidence)
    both = F.array_sort(F.concat(four, six))
    return F.when(text.rlike(r"[0-9A-Fa-f]\.[0-9]|:[0-9A-Fa-f]*:"), both).otherwise(none_of(FINDING))


IBAN = r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?:[A-Za-z0-9]{11,30}+|(?: [A-Za-z0-9]{4})++(?: [A-Za-z0-9]{1,3})?)(?![A-Za-z0-9])"


def find_iban(text: Column) -> Column:
    """Compact or in groups of four, of the country's length, with the remainder 1 modulo 97."""

    def exact(m: Column) -> Column:
        size = ck.iban_length(F.substring(m["m"], 1, 2))
        size = F.when(F.contains(m["m"], F.lit(" ")), size + F.floor((size - 1) / 4)).otherwise(size).cast("int")
        whole = F.substring(m["m"], F.lit(1), size)
        ends = (F.length(m["m"]) == size) | ((F.length(m["m"]) > size) & F.substring(m["m"], size + 1, F.lit(1)).isin(" "))
        run = F.when(ends, whole).otherwise(F.lit(""))
        return F.struct(run.alias("m"), m["at"].alias("at"), m["start_utf8"].alias("start_utf8"), (m["start_utf8"] + F.length(run)).alias("end_utf8"))

    def evidence(m: Column) -> Column:
        compact = F.upper(F.replace(m["m"], F.lit(" "), F.lit("")))
        return F.when(F.length(m["m"]) > 0, _if(ck.mod97(compact) == 1, VALIDATED))

    return _found("IBAN", F.transform(matches(text, IBAN, "[A-Za-z]{2}[0-9]{2}"), exact), evidence)


INN = r"(?<![0-9])[0-9]{12}(?![0-9])"


def find_ru_inn(text: Column) -> Column:
    """Twelve digits, both check digits right."""
    return _found("RU_INN", matches(text, INN, "[0-9]{12}"), lambda m: _if(ck.inn_person(m["m"]), VALIDATED))


SNILS = (
    r"(?<![0-9])(?:[0-9]{11}|[0-9]{3}-[0-9]{3}-[0-9]{3}[\- ][0-9]{2}|[0-9]{3}\.[0-9]{3}\.[0-9]{3} [0-9]{2}"
    r"|[0-9]{3}([   ‐‑])[0-9]{3}\1[0-9]{3}\1[0-9]{2})(?![0-9])"
)


def find_ru_snils(text: Column) -> Column:
    """Eleven digits above 001001998 that check, or near the number's name without being one digit repeated."""

    def evidence(m: Column) -> Column:
        d = F.regexp_replace(m["m"], "[^0-9]", "")
        context = near(text, m["at"], F.length(m["m"]), 32, "снилс") & ~ck.one_digit_repeated(d)
        return F.when(F.substring(d, 1, 9) > "001001998", F.when(ck.snils(d), F.lit(VALIDATED)).when(context, F.lit(CONTEXTUAL)))

    return _found("RU_SNILS", matches(text, SNILS, "[0-9]{3}"), evidence)


PASSPORT = r"(?<![0-9])(?:[0-9]{4} [0-9]{6}|[0-9]{2} [0-9]{2} [0-9]{6}|[0-9]{2}-[0-9]{2} [0-9]{6}|[0-9]{2} [0-9]{2} № [0-9]{6})(?![0-9])"
_CYRILLIC = "[А-Яа-яЁё]"


def find_ru_passport(text: Column) -> Column:
    """Series and number in four layouts, within 64 code points of a word for passport or of both series and number."""

    def evidence(m: Column) -> Column:
        size = F.length(m["m"])
        word = prefixed(text, m["at"], size, 64, "паспорт", _CYRILLIC)
        both = near(text, m["at"], size, 64, "серия", _CYRILLIC) & near(text, m["at"], size, 64, "номер", _CYRILLIC)
        return _if(word | both, CONTEXTUAL)

    return _found("RU_PASSPORT", matches(text, PASSPORT, "[0-9]{6}"), evidence)


OMS = r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}([ \-‐‑  ])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])"
_GAP = r"[^\p{L}\p{Nd}_]+"
#: The policy's names nearby (fixed values).
OMS_WORDS = f"омс|полис{_GAP}обязательного{_GAP}медицинского{_GAP}страхования"


def find_ru_oms(text: Column) -> Column:
    """Sixteen digits that check, or near the policy's name without being one digit repeated."""

    def evidence(m: Column) -> Column:
        d = F.regexp_replace(m["m"], "[^0-9]", "")
        context = near(text, m["at"], F.length(m["m"]), 48, OMS_WORDS) & ~ck.one_digit_repeated(d)
        return F.when(ck.oms(d), F.lit(VALIDATED)).when(context, F.lit(CONTEXTUAL))

    return _found("RU_OMS", matches(text, OMS, "[0-9]{4}"), evidence)


FINDERS = dict(zip(NAMES, (find_email, find_phone_ru, find_payment_card, find_ip, find_iban, find_ru_inn, find_ru_snils, find_ru_passport, find_ru_oms), strict=True))
__all__ = ["FINDERS", "INFO", "NAMES", "TYPES", "finding"]
