"""Span algebra: matches with offsets, greedy resolution, masking. All inside a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import let, running_max, running_sum
from ..schema import SPAN
from .rules import Rule, gate_of

EMPTY = f"cast(array() as array<{SPAN}>)"


def _record(rule: Rule, rank: int) -> Column:
    parts = {"rank": rank, "entity_type": rule.entity_type, "pattern": rule.java, "group": rule.group, "quoted": rule.quoted}
    return F.struct(*[F.lit(v).alias(k) for k, v in parts.items()])


def matches(text: Column, rule: Column, source: str = "regex") -> Column:
    """All matches of a rule record, in text order.

    Offsets are running sums of the lengths of what lies between and inside matches, which counts
    code points; index functions of the engine count UTF-16 units.
    """
    whole = F.regexp_extract_all(text, rule["pattern"], F.lit(0))

    def spans(whole: Column) -> Column:
        value = F.when(rule["group"] == 0, whole).otherwise(F.regexp_extract_all(text, rule["pattern"], rule["group"]))
        gap = F.transform(F.slice(F.split(text, rule["pattern"], -1), 1, F.size(whole)), lambda g: F.char_length(g))
        ends = running_sum(F.zip_with(gap, whole, lambda g, w: g + F.char_length(w)))
        return F.transform(F.arrays_zip(whole.alias("whole"), value.alias("value"), ends.alias("end")), span)

    def span(x: Column) -> Column:
        stop = x["end"] - F.when(rule["quoted"] & x["whole"].rlike("[\"']$"), 1).otherwise(0)
        return F.struct(
            (stop - F.char_length(x["value"])).alias("start"),
            stop.alias("end"),
            rule["entity_type"].alias("entity_type"),
            x["value"].alias("text"),
            F.lit(1.0).alias("confidence"),
            F.lit(source).alias("source"),
            rule["rank"].alias("rank"),
        )

    # most rules that pass their gate match nothing: those need no second pass
    return let(whole, lambda w: F.when(F.size(w) > 0, spans(w)).otherwise(F.expr(EMPTY)))


def accepted(text: Column, found: Column, rules: Sequence[Rule]) -> Column:
    """The matches that pass their rule's check."""
    shared: dict[object, list[int]] = {}
    for rank, rule in enumerate(rules):
        if rule.check:
            shared.setdefault(rule.check, []).append(rank)

    def ok(s: Column) -> Column:
        out = None
        for check, ranks in shared.items():
            mine, good = s["rank"].isin(*ranks), check(s["text"], text, s["start"], s["end"])
            out = F.when(mine, good) if out is None else out.when(mine, good)
        return out.otherwise(F.lit(True))

    return F.filter(found, ok) if shared else found


def candidates(text: Column, rules: Sequence[Rule], lower: Column | None = None, source: str = "regex", digit: Column | None = None) -> Column:
    """The accepted matches of all rules in rule order.

    The plan holds the matcher once, over an array of the rules whose gate the text passes.
    """
    low = F.lower(text) if lower is None else lower
    has = text.rlike(r"\p{Nd}") if digit is None else digit
    if not rules:
        return F.expr(EMPTY)
    records = []
    for rank, rule in enumerate(rules):
        gate, record = gate_of(rule, text, low, has), _record(rule, rank)
        records.append(record if gate is None else F.when(gate, record))
    return accepted(text, F.flatten(F.transform(F.array_compact(F.array(*records)), lambda r: matches(text, r, source))), rules)


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _disjoint(placed: Column) -> Column:
    pairs = F.zip_with(F.slice(placed, 1, F.greatest(F.size(placed) - 1, F.lit(0))), F.slice(placed, 2, F.size(placed)), lambda a, b: a["end"] <= b["start"])
    return F.forall(pairs, lambda ok: ok)


def _accept(ordered: Column) -> Column:
    """Take spans in order, each unless it meets one already taken; then sort by place.

    Spans that are disjoint to begin with, however many, need only the sort. Others fall into clusters of spans
    that hang together, and only inside a cluster can one span keep another out.
    """

    def fold(cluster: Column) -> Column:
        mine = F.transform(F.array_sort(F.transform(cluster, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"])
        return F.array_sort(F.aggregate(mine, F.expr(EMPTY), lambda acc, c: F.when(F.exists(acc, lambda a: overlap(a, c)), acc).otherwise(F.concat(acc, F.array(c)))))

    def clusters(placed: Column) -> Column:
        reach = running_max(F.transform(placed, lambda x: x["s"]["end"]))
        # an empty span meets those that it lies strictly inside, so touching is no meeting
        first = F.zip_with(placed, F.concat(F.array(F.lit(0)), F.slice(reach, 1, F.size(placed) - 1)), lambda x, before: x["start"] >= before)
        at = F.filter(F.transform(first, lambda yes, i: F.when(yes, i + 1)), lambda x: x.isNotNull())
        return let(at, lambda cuts: F.transform(cuts, lambda a, k: F.slice(placed, a, F.coalesce(F.get(cuts, k + 1), F.size(placed) + 1) - a)))

    def resolved(spans: Column) -> Column:
        keyed = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s.alias("s"))))
        return let(keyed, lambda placed: F.flatten(F.transform(clusters(placed), fold)))

    return let(ordered, lambda spans: let(F.array_sort(spans), lambda placed: F.when(_disjoint(placed), placed).otherwise(resolved(spans))))


def _by(spans: Column, *keys) -> Column:
    """Spans sorted by the keys, then by place in the input."""
    keyed = F.transform(spans, lambda s, i: F.struct(*[k(s).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def _longest(s: Column) -> Column:
    return s["start"] - s["end"]


def resolve(spans: Column) -> Column:
    """Longest first, then the earlier rule; the result is disjoint and sorted."""
    return _accept(_by(spans, _longest, lambda s: s["rank"]))


def resolve_tier(spans: Column) -> Column:
    """Rules before keywords whatever their length, then longest, then surest, then input order."""
    return _accept(_by(spans, lambda s: F.when(s["source"] == "regex", 0).otherwise(1), _longest, lambda s: -s["confidence"]))


def merge(spans: Column) -> Column:
    """Rules and keywords before all else, then longest, then surest, then leftmost."""
    tier = lambda s: F.when(s["source"].isin("regex", "custom"), 0).otherwise(1)
    return _accept(_by(spans, tier, _longest, lambda s: -s["confidence"], lambda s: s["start"]))


def mask(text: Column, spans: Column) -> Column:
    """Every span's characters become full blocks; the length stays."""
    n = F.char_length(text)

    def cover(acc: Column, s: Column) -> Column:
        start, end = F.greatest(s["start"], F.lit(0)), F.least(s["end"], n)
        return F.when(end > start, F.concat(F.substring(acc, F.lit(1), start), F.repeat(F.lit("█"), end - start), F.substring(acc, end + 1, n))).otherwise(acc)

    return F.aggregate(spans, text, cover)
