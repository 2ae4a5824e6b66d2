"""Secret scan: three base patterns, plus sliding-window Shannon entropy over candidate strings.

All matching runs over whole texts inside the JVM. Offsets are code points, end exclusive; null
counts as the empty text and has no spans. Per kind, matches are leftmost and non-overlapping and
matches that fail their length test are dropped. An entropy span is a candidate string with a
window whose entropy reaches its character class's threshold; it is left out if an allow pattern
describes all of it or if it overlaps a base span. Every row stands alone, so ties, repeated rows and empty
tables need nothing special, and other columns are not read.

The entropy of a window of w characters is log2(w) - S/w with S the sum of c*log2(c) over the
character counts. A step of the window changes two counts, and S by their four terms. Terms are
whole numbers of 2**-32, so that S is the same whatever the order of steps, and counts are five-bit
fields of six numbers, so that a step writes two fields and copies no table. Long texts cost one pass,
span offsets one running sum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, pieces, running_sum

# The base kinds, in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"


@dataclass(frozen=True)
class CharClass:
    name: str
    pattern: str
    alphabet: str
    window: int
    bits: float


CLASSES = (
    CharClass("hex", r"^[0-9A-Fa-f]+$", "0123456789abcdef", 16, 3.0),
    CharClass("base64", r"^[0-9A-Za-z+/_=-]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 20, 3.8),
)
CANDIDATE = r"[0-9A-Za-z+/_=-]{20,}"  # greedy, so always a whole run
# What an allowed candidate is: every rule describes all of it, for what merely stands beside a secret must not hide it.
UUID = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
NO_DIGIT, NO_LETTER = r"^[^0-9]+$", r"^[^A-Za-z]+$"  # words joined by signs; numbers, dates, rules
#: Made-up values are nothing but stand-in words, labels, runs of the alphabet and signs: nothing is left without these.
STAND_IN = (
    r"(?i)example|sample|placeholder|dummy|changeme|xxxx+|your|my|test|api|access|secret|private|key|token|password|passwd|value|id|here"
    r"|0?1234567890?|abcdefgh(?:ijklmnop(?:qrstuvwxyz)?)?|[+/_=-]"
)
#: A path has two plain names or more behind slashes; a name is words joined by - or _, a word letters then digits.
WORD = r"^(?:[A-Z]?[a-z]{1,24}(?:[A-Z][a-z]{2,24}){0,3}[0-9]{0,4}|[A-Z]{1,24}[0-9]{0,4}|[0-9]{1,4})$"
_SHIFT, _FIELDS = 5, 12
UNIT = 1 << 32
TERMS = tuple(round(c * math.log2(c) * UNIT) if c else 0 for c in range(22))


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches as array<struct<s, e, v>>; v is the given group's text."""

    def placed(whole: Column) -> Column:
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(whole)), lambda p: F.char_length(p))
        ends = running_sum(F.zip_with(gaps, whole, lambda g, m: g + F.char_length(m)))
        return F.transform(F.arrays_zip(whole.alias("m"), ends.alias("e"), value.alias("v")), lambda x: F.struct((x.e - F.char_length(x.m)).alias("s"), x.e.alias("e"), x.v.alias("v")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def peak_entropy(value: Column, cls: CharClass) -> Column:
    """The largest entropy of any window of ``cls.window`` characters; 0 for shorter values."""
    return math.log2(cls.window) - least_sum(value, cls) / float(cls.window * UNIT)


def least_sum(value: Column, cls: CharClass) -> Column:
    """The smallest S of any window, in units: that of the largest entropy."""
    folded = F.lower(value) if cls.name == "hex" else value
    w, fields = cls.window, -(-len(cls.alphabet) // _FIELDS)
    terms = F.array(*[F.lit(t) for t in TERMS])
    places = F.transform(F.split(folded, ""), lambda ch: F.instr(F.lit(cls.alphabet), ch) - 1)

    def slot(place: Column) -> Column:
        return (place % _FIELDS) * _SHIFT

    def count(acc: Column, place: Column) -> Column:
        field = F.lit(0).cast("long")
        for k in range(fields):
            field = F.when(F.floor(place / _FIELDS) == k, acc[f"f{k}"]).otherwise(field)
        return F.call_function("shiftright", field, slot(place)).bitwiseAND((1 << _SHIFT) - 1).cast("int")

    def added(acc: Column, place: Column, by: int) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot(place)) * by
        return F.struct(*[(acc[f"f{k}"] + F.when(F.floor(place / _FIELDS) == k, bit).otherwise(0)).alias(f"f{k}") for k in range(fields)])

    def step(acc: Column, x: Column) -> Column:
        def left(c: Column) -> Column:  # the count that goes down, once the other has gone up
            s = acc["s"] + F.get(terms, c["n"] + 1) - F.get(terms, c["n"])
            return let(
                F.struct(added(acc["c"], x["into"], 1).alias("c"), s.alias("s")),
                lambda up: let(
                    F.when(x["out"] >= 0, count(up["c"], x["out"])).otherwise(0),
                    lambda n: let(
                        F.struct(
                            F.when(x["out"] >= 0, added(up["c"], x["out"], -1)).otherwise(up["c"]).alias("c"),
                            F.when(x["out"] >= 0, up["s"] + F.get(terms, n - 1) - F.get(terms, n)).otherwise(up["s"]).alias("s"),
                        ),
                        lambda done: F.struct(done["c"].alias("c"), done["s"].alias("s"), F.when(x["i"] >= w, F.least(acc["least"], done["s"])).otherwise(acc["least"]).alias("least")),
                    ),
                ),
            )

        return let(F.struct(count(acc["c"], x["into"]).alias("n")), left)

    entering = let(
        places,
        lambda p: F.transform(p, lambda at, i: F.struct((i + 1).alias("i"), at.alias("into"), F.when(i >= w, F.get(p, i - w)).otherwise(F.lit(-1)).alias("out"))),
    )
    none = F.struct(*[F.lit(0).cast("long").alias(f"f{k}") for k in range(fields)])
    most = F.lit(round(w * math.log2(w) * UNIT)).cast("long")
    start = F.struct(none.alias("c"), F.lit(0).cast("long").alias("s"), most.alias("least"))
    return F.aggregate(entering, start, step, lambda acc: acc["least"])


def limit(cls: CharClass) -> int:
    """The largest S, in units, that a window of the class's entropy may have."""
    return math.floor((math.log2(cls.window) - cls.bits) * cls.window * UNIT)


def allowed(value: Column) -> Column:
    """Whether a candidate is nothing but an identifier, a made-up value, words, numbers, or a path of plain names."""
    names = F.filter(F.split(value, "/", -1), lambda x: x != "")
    plain = F.forall(names, lambda n: F.forall(F.split(n, "[_-]", -1), lambda x: x.rlike(WORD)))
    behind = F.size(names) - F.when(value.startswith("/"), 0).otherwise(1)
    path = (value.startswith("/") | value.contains("//")) & ~value.contains("///") & (behind >= 2) & plain
    return value.rlike(UUID) | value.rlike(NO_DIGIT) | value.rlike(NO_LETTER) | (F.regexp_replace(value, STAND_IN, "") == "") | path


def _added(text: Column, base: Column) -> Column:
    """Entropy spans among the candidates, without allowed ones and without those a base span meets."""

    def secret(x: Column, met: Column) -> Column:
        hot = F.lit(False)
        for cls in reversed(CLASSES):  # the narrowest class that holds the whole string decides
            hot = F.when(x.v.rlike(cls.pattern), least_sum(x.v, cls) <= limit(cls)).otherwise(hot)
        return F.when(allowed(x.v) | met, False).otherwise(hot)

    def meets(x: Column, parts: Column) -> Column:
        return F.exists(parts, lambda p: (p.lo < x.e) & (x.s < p.hi) & F.exists(p.own, lambda b: (b.s < x.e) & (x.s < b.e)))

    # base spans by place, in pieces with their bounds: a candidate looks into the pieces that it reaches
    ordered = F.array_sort(F.transform(base, lambda b: F.struct(b.s.alias("s"), b.e.alias("e"))))
    bounded = F.transform(pieces(ordered, 64), lambda p: F.struct(F.get(p, F.lit(0)).s.alias("lo"), F.array_max(F.transform(p, lambda b: b.e)).alias("hi"), p.alias("own")))
    return let(bounded, lambda parts: F.filter(spans(text, CANDIDATE), lambda x: secret(x, F.coalesce(meets(x, parts), F.lit(False)))))


def _listed(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.get(names, x.k), x.s.cast("string"), x.e.cast("string"))), ","
    )


def _of_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x.s.alias("s"), F.lit(kind).alias("k"), x.e.alias("e")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, base and added as array<struct<s, k, e>>, k indexing KINDS."""
    none = F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")
    t = F.col("t")
    base = (
        docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
        .select(
            "doc_id",
            "t",
            F.when(t.rlike(r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""), F.filter(spans(t, ASSIGN, 2), lambda x: F.char_length(x.v) >= 12))
            .otherwise(none)
            .alias("assign"),
            F.when(t.contains("AKIA"), F.filter(spans(t, ACCESS), lambda x: F.char_length(x.v) >= 18)).otherwise(none).alias("access"),
            F.when(t.rlike(HEX), spans(t, HEX)).otherwise(none).alias("hex"),
        )
        .select("doc_id", "t", F.concat(_of_kind(F.col("assign"), 0), _of_kind(F.col("access"), 1), _of_kind(F.col("hex"), 2)).alias("base"))
    )
    empty = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    return base.select("doc_id", "base", F.when(t.rlike(CANDIDATE), _of_kind(_added(t, F.col("base")), 3)).otherwise(empty).alias("added"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x.k == kind)).cast("long")

    return find_secrets(docs, id_col, text_col).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "added")).alias("spans"),
    )
