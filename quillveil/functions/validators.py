"""Checks of a matched value, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT = 40

# Card prefixes, employer-number prefixes, context words.
CARD_PREFIXES = r"^(?:4|5[1-5]|3[47]|6011|65|30[0-5]|36|38|35)"
EIN_PREFIXES = (
    "01 02 03 04 05 06 10 11 12 13 14 15 16 20 21 22 23 24 25 26 27 30 31 32 33 34 35 36 37 38 39 "
    "40 41 42 43 44 45 46 47 48 50 51 52 53 54 55 56 57 58 59 60 61 62 63 64 65 66 67 68 "
    "71 72 73 74 75 76 77 80 81 82 83 84 85 86 87 88 90 91 92 93 94 95 98 99"
).split()
SSN_WORDS = ("ssn", "social security")
EIN_WORDS = ("ein", "employer", "fein", "tax id", "taxpayer id")
ROUTING_WORDS = ("routing", "aba", "r/t", "rtn")
ACCOUNT_WORDS = ("account", "acct", "a/c")


def near(text: Column, start: Column, end: Column, words: tuple[str, ...]) -> Column:
    """Any word occurs, in any case and even inside a longer one, within 40 characters of the match."""
    lo = F.greatest(start - CONTEXT, F.lit(0))
    return F.lower(F.substring(text, lo + 1, end + CONTEXT - lo)).rlike("|".join(words))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\D", "")


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character."""
    chars = F.split(value, "")
    n = F.size(chars).cast("double")
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return -F.aggregate(share, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))


def luhn(value: Column) -> Column:
    ds = F.transform(F.split(F.reverse(value), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2).otherwise(c.cast("int")))
    return F.aggregate(ds, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def card(value: Column) -> Column:
    d = digits(value)
    return F.char_length(d).between(13, 19) & d.rlike(CARD_PREFIXES) & luhn(d)


def aba(value: Column) -> Column:
    at = [F.substring(value, i + 1, 1).cast("int") for i in range(9)]
    total = 3 * (at[0] + at[3] + at[6]) + 7 * (at[1] + at[4] + at[7]) + at[2] + at[5] + at[8]
    return (value != "000000000") & (total % 10 == 0)


def ssn(value: Column) -> Column:
    return digits(value).rlike(r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}$")


def itin(value: Column) -> Column:
    return value.substr(5, 2).cast("int").between(70, 89)


def ein_prefix(value: Column) -> Column:
    return value.substr(1, 2).isin(EIN_PREFIXES)


def nanp(value: Column) -> Column:
    bare = F.regexp_replace(value, r"(?dUi)\s*(?:ext\.?|x)\s*\d{1,10}$", "")
    return bare.rlike(r"(?dU)^\+?1?\D*([2-9]\d{2})\D*([2-9]\d{2})\D*(\d{4})$")


def international(value: Column) -> Column:
    return F.char_length(digits(value)).between(8, 15)


def email(value: Column) -> Column:
    domain = F.substring_index(value, "@", -1)
    return ~domain.contains("..") & F.substring_index(domain, ".", -1).rlike(r"^[A-Za-z]{2,24}$")


def ipv4(value: Column) -> Column:
    return value.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$")


def ipv6(value: Column) -> Column:
    groups = r"^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?$"
    left = F.substring_index(value, "::", 1)
    right = F.substring(value, F.char_length(left) + 3, 100)
    count = lambda s: F.when(s == "", 0).otherwise(F.size(F.split(s, ":")))
    short = left.rlike(groups) & right.rlike(groups) & (count(left) + count(right) <= 7)
    return F.when(value.contains("::"), short).otherwise(value.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"))


def credential(value: Column) -> Column:
    return (F.char_length(value) >= 6) & value.rlike(r"(?U)[\p{Alnum}]")


def password(value: Column) -> Column:
    return (F.char_length(value) >= 6) & value.rlike(r"(?U)\S")


def labelled_id(value: Column) -> Column:
    return F.char_length(value).between(4, 25) & value.rlike(r"(?U)\d")


def secret(value: Column, least: int) -> Column:
    return (F.char_length(value) >= least) & (entropy(value) >= 3.0 - 1e-9)


def jwt(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: F.char_length(x) >= 4)
