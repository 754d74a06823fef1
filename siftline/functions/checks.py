"""Checksums and spellings of numbers as column expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths of account numbers by country, and the weights of the PESEL check digit.
IBAN_LENGTHS = {"PL": 28, "DE": 22, "GB": 22, "FR": 27, "ES": 24, "IT": 27, "NL": 18, "CZ": 24, "SK": 24}
PESEL_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[ -]", "")


def card_ok(number: Column) -> Column:
    """T3. 13 to 19 digits, not all equal, a network's first digit (2-6; 13 digits only 4), Luhn."""

    def check(d: Column) -> Column:
        shape = d.rlike("^[2-6][0-9]{12,18}$") & ~d.rlike(r"^([0-9])\1*$") & ((F.length(d) != 13) | d.startswith("4"))
        return shape & F.call_function("luhn_check", d)

    return F.coalesce(let(digits_only(number), check), F.lit(False))


def pesel_ok(number: Column) -> Column:
    """T4. Eleven digits with a valid check digit, month (century coded by twenties) and day."""

    def digit(k: int) -> Column:
        return F.substring(number, k + 1, 1).cast("int")

    total = sum((digit(k) * w for k, w in enumerate(PESEL_WEIGHTS[1:], 1)), digit(0) * PESEL_WEIGHTS[0])
    month, day = F.substring(number, 3, 2).cast("int") % 20, F.substring(number, 5, 2).cast("int")
    valid = ((10 - total % 10) % 10 == digit(10)) & month.between(1, 12) & day.between(1, 31)
    return F.when(number.rlike("^[0-9]{11}$"), valid).otherwise(False)


def _mod97(code: Column) -> Column:
    """code modulo 97, letters as 10 to 35; folded digit by digit, as no number type is wide enough."""
    value = lambda c: F.conv(c, 36, 10).cast("long")
    step = lambda a, c: F.pmod(a * F.when(value(c) > 9, F.lit(100)).otherwise(F.lit(10)) + value(c), F.lit(97))
    return F.aggregate(F.array_remove(F.split(code, ""), ""), F.lit(0).cast("long"), step)


def iban_ok(text: Column) -> Column:
    """T5. An international account number: length of its country, if known, and remainder 1."""
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])

    def check(s: Column) -> Column:
        fits = F.length(s).between(15, 34) & (F.coalesce(F.try_element_at(lengths, F.left(s, F.lit(2))), F.length(s)) == F.length(s))
        return F.when(fits & s.rlike("^[0-9A-Z]+$"), _mod97(F.concat(F.substr(s, F.lit(5)), F.left(s, F.lit(4)))) == 1).otherwise(False)

    return F.coalesce(let(F.upper(F.replace(text, F.lit(" "), F.lit(""))), check), F.lit(False))


def nrb_ok(text: Column) -> Column:
    """T5. A Polish account number without its country code."""
    return iban_ok(F.concat(F.lit("PL"), digits_only(text)))


def number_form(value: Column) -> Column:
    """L1. The normal form of a numeric column: no sign, six decimals at most, no trailing zeros; null for NaN."""
    text = F.format_string("%.6f", F.abs(value.cast("double")))
    trimmed = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) < float("inf")), trimmed)


def integer_form(value: Column) -> Column:
    """L1. The normal form of an integer column."""
    return F.regexp_replace(value.cast("string"), "^-", "")


def number_spellings(value: Column) -> Column:
    """L6. How a number may be written: 6200, 6200.0, 6,200, 6 200, 6.200 and with narrow or no-break spaces."""

    def of(x: Column) -> Column:
        whole = F.floor(x)
        plain = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.abs(whole).cast("string"))
        grouped = F.regexp_replace(plain, r"(?<=\d)(?=(?:\d{3})+$)", ",")
        spelled = F.array(plain, F.concat(plain, F.lit(".0")), grouped, *[F.replace(grouped, F.lit(","), F.lit(s)) for s in (" ", ".", " ", " ")])
        text = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), r"\.$", "")
        fraction = F.array(text, F.concat(F.regexp_replace(F.substring_index(text, ".", 1), r"(?<=\d)(?=(?:\d{3})+$)", ","), F.lit("."), F.substring_index(text, ".", -1)))
        return F.array_distinct(F.when(x == whole, spelled).otherwise(fraction))

    return let(value.cast("double"), of)


def markdown_escape(text: Column) -> Column:
    """Characters that markdown reads as markup get a backslash; angle brackets and ampersands become entities."""
    tags = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(tags, r"([\\`*_\[\]|~#])", r"\\$1")


def urls(text: Column) -> Column:
    """T11. All web addresses in a text."""
    return F.regexp_extract_all(text, F.lit(r"(?i)(https?://[^\s'\"<>()\[\]{}`]+)"), F.lit(1))


def head_and_tail(text: Column, most: int = 4000) -> Column:
    """T15. A longer text becomes its first and last half-budget with a line between that counts what is left out (the line is a fixed value)."""
    half = most // 2
    note = F.concat(F.lit("\n[... "), (F.length(text) - 2 * half).cast("string"), F.lit(" characters omitted ...]\n"))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(half)), note, F.right(text, F.lit(half))))


def parse_risk(reply: Column) -> Column:
    """T15. The number of a reply {"risk": 0..1}, perhaps in one code fence; null for anything else."""
    body = F.regexp_replace(F.trim(reply), r"(?s)\A```(?:json)?\s*(.*?)\s*```\z", "$1")
    fine = (F.json_object_keys(body) == F.array(F.lit("risk"))) & F.trim(body).rlike(r"(?s)\A\{\s*\"risk\"\s*:\s*-?[0-9.]+(?:[eE][+-]?[0-9]+)?\s*\}\z")
    risk = F.get_json_object(body, "$.risk").try_cast("double")
    return F.when(F.coalesce(fine, F.lit(False)) & risk.between(0, 1), risk)
