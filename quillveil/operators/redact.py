"""Detection in two tiers, placeholders, redaction and reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import PIECE, let, pieces, running_max, running_sum
from ..runtime import fresh
from ..schema import Settings
from .rules import RULES, Rule, folded, literal_rule
from .spans import EMPTY, candidates, mask, merge, overlap, resolve, resolve_tier

#: A model takes a DataFrame and the names of its masked-text and output columns and adds, per row,
#: an array of spans.
Model = Callable[[DataFrame, str, str], DataFrame]
LEAST_CONFIDENCE, LEAST_LENGTH = 0.6, 3


def fold(value: Column) -> Column:
    """Case folding: lower case with sharp s as ss."""
    return F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))


def propagated(text: Column, spans: Column) -> Column:
    """Other whole-word occurrences of detected values, clear of all spans so far.

    The first sure enough span of a value fixes type and confidence.
    """
    keyed = F.transform(
        F.filter(spans, lambda s: (s["confidence"] >= LEAST_CONFIDENCE) & (F.char_length(F.trim(s["text"])) >= LEAST_LENGTH)),
        lambda s: F.struct(fold(s["text"]).alias("key"), s.alias("s")),
    )
    first = F.aggregate(
        keyed,
        F.filter(keyed, lambda x: F.lit(False)),
        lambda acc, x: F.when(F.exists(acc, lambda a: a["key"] == x["key"]), acc).otherwise(F.concat(acc, F.array(x))),
    )

    def spread(acc: Column, x: Column) -> Column:
        s = x["s"]
        pattern = F.concat(F.lit(r"(?dUi)(?<!\w)\Q"), F.replace(s["text"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))
        hits, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
        ends = running_sum(F.zip_with(F.transform(F.slice(gaps, 1, F.size(hits)), lambda g: F.char_length(g)), hits, lambda g, h: g + F.char_length(h)))
        placed = F.zip_with(
            hits,
            ends,
            lambda h, end: F.struct(
                (end - F.char_length(h)).alias("start"),
                end.alias("end"),
                s["entity_type"].alias("entity_type"),
                h.alias("text"),
                s["confidence"].alias("confidence"),
                F.lit("propagated").alias("source"),
                F.lit(1000).alias("rank"),
            ),
        )
        return F.concat(acc, F.filter(placed, lambda p: (p["start"] != s["start"]) & ~F.exists(F.concat(spans, acc), lambda o: overlap(o, p))))

    return F.aggregate(first, F.expr(EMPTY), spread)


@lru_cache(maxsize=32)
def _resolved(raw: str, low: str, digit: str, rules: tuple[Rule, ...]) -> Column:
    """The resolver over all rules; building it takes thousands of calls, so it is kept."""
    return resolve(candidates(F.col(raw), rules, F.col(low), digit=F.col(digit)))


def detect(
    df: DataFrame,
    text_col: str = "text",
    out: str = "spans",
    settings: Settings = Settings(),
    rules: tuple[Rule, ...] = RULES,
    model: Model | None = None,
) -> DataFrame:
    """Adds the disjoint, sorted spans of the text. Null text has none."""
    low, digit, raw = (fresh([*df.columns, out], x) for x in ("_low", "_digit", "_raw"))
    t = F.col(raw)
    found = df.withColumn(raw, F.coalesce(F.col(text_col), F.lit("")))
    found = found.withColumns({low: F.lower(t), digit: t.rlike(r"\p{Nd}")})
    found = found.withColumn(out, _resolved(raw, low, digit, tuple(rules)) if settings.enable_rules else F.expr(EMPTY))
    if keywords := [k for k in settings.custom_keywords if k.strip()]:
        custom = candidates(t, [literal_rule(k) for k in keywords], folded(F.col(low)), "custom", F.col(digit))
        found = found.withColumn(out, resolve_tier(F.concat(F.col(out), custom)))
    found, t = found.drop(low, digit, raw), F.coalesce(F.col(text_col), F.lit(""))
    if settings.enable_model and model:
        masked, extra = fresh(found.columns, "_masked"), fresh(found.columns, "_model")
        found = model(found.withColumn(masked, mask(t, F.col(out))), masked, extra)
        sliced = F.transform(F.col(extra), lambda s: s.withField("text", F.substring(t, s["start"] + 1, s["end"] - s["start"])))
        found = found.withColumn(out, merge(F.concat(F.col(out), sliced))).drop(masked, extra)
    if settings.propagates:
        found = found.withColumn(out, merge(F.concat(F.col(out), propagated(t, F.col(out)))))
    return found


def _previous(values: Column, first: Column) -> Column:
    return F.concat(F.array(first), F.slice(values, 1, F.size(values) - 1))


def _numbers(keyed: Column) -> Column:
    """Of structs (type, value), the number of each value within its type by first place, by sorting alone."""

    def firsts(rows: Column) -> Column:  # sorted by type, value, place: the first place of each value
        head = F.zip_with(rows, _previous(rows, F.lit(None)), lambda x, y: y.isNull() | (x["type"] != y["type"]) | (x["value"] != y["value"]))
        at = running_max(F.transform(head, lambda yes, i: F.when(yes, i).otherwise(0)))
        return F.array_sort(F.zip_with(rows, at, lambda x, k: F.struct(x["type"].alias("type"), F.get(rows, k)["i"].alias("first"), x["i"].alias("i"))))

    def counted(rows: Column) -> Column:  # sorted by type, first place, place
        before = _previous(rows, F.lit(None))
        new = running_sum(F.zip_with(rows, before, lambda x, y: (y.isNull() | ~x.getField("first").eqNullSafe(y["first"])).cast("int")))
        opens = F.zip_with(rows, before, lambda x, y: y.isNull() | (x["type"] != y["type"]))

        def within(n: Column) -> Column:
            start = running_max(F.zip_with(opens, n, lambda yes, k: F.when(yes, k - 1).otherwise(0)))
            return F.transform(F.array_sort(F.transform(F.arrays_zip(rows.alias("x"), n.alias("n"), start.alias("b")), lambda z: F.struct(z["x"]["i"].alias("i"), (z["n"] - z["b"]).alias("n")))), lambda z: z["n"])

        return let(new, within)

    placed = F.array_sort(F.transform(keyed, lambda k, i: F.struct(k["type"].alias("type"), k["value"].alias("value"), i.alias("i"))))
    return let(placed, lambda rows: let(firsts(rows), counted))


def placeholders(spans: Column) -> Column:
    """Spans, sorted by place, with ``placeholder``: [TYPE_n], n counting distinct values of the type by first place."""
    keyed = F.transform(spans, lambda s: F.struct(s["entity_type"].alias("type"), fold(s["text"]).alias("value")))
    numbers = F.when(F.size(spans) > 0, _numbers(keyed)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.zip_with(spans, numbers, lambda s, n: s.withField("placeholder", F.concat(F.lit("["), s["entity_type"], F.lit("_"), n.cast("string"), F.lit("]"))))


def redacted(text: Column, placed: Column, public: tuple[str, ...]) -> Column:
    """The text with every span of a non-public type replaced by its placeholder.

    Spans are worked off in pieces, each inside its own part of the text, since taking a part out of a text costs
    its distance from the text's beginning.
    """
    hidden = F.filter(placed, lambda s: ~s["entity_type"].isin(*public)) if public else placed

    def told(piece: Column, base: Column, part: Column) -> Column:
        done = F.aggregate(
            piece,
            F.struct(base.alias("at"), F.lit("").alias("out")),
            lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(part, acc["at"] - base + 1, s["start"] - acc["at"]), s["placeholder"]).alias("out")),
        )
        return done["out"]

    def whole(spans: Column) -> Column:
        def one(piece: Column, k: Column) -> Column:
            base = F.when(k == 0, F.lit(0)).otherwise(F.get(spans, k * PIECE - 1)["end"])
            return let(base, lambda b: let(F.substring(text, b + 1, F.element_at(piece, -1)["end"] - b), lambda part: told(piece, b, part)))

        last = F.element_at(spans, -1)["end"]
        return F.concat(F.array_join(F.transform(pieces(spans), one), ""), F.substring(text, last + 1, F.char_length(text)))

    return let(hidden, lambda spans: F.when(F.size(spans) > 0, whole(spans)).otherwise(text))


def found(spans: Column, public: tuple[str, ...]) -> Column:
    """How many spans are of non-public types."""
    return F.size(F.filter(spans, lambda s: ~s["entity_type"].isin(*public)) if public else spans)


@lru_cache(maxsize=32)
def _finish(text_col: str, public: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """Placed spans, their number and the redacted text; kept, since building them takes many calls."""
    t, spans = F.coalesce(F.col(text_col), F.lit("")), F.col("spans")
    return placeholders(spans), found(spans, public).cast("int"), F.when(F.col("found") == 0, t).otherwise(redacted(t, spans, public))


def redact(df: DataFrame, text_col: str = "text", settings: Settings = Settings(), rules: tuple[Rule, ...] = RULES, model: Model | None = None) -> DataFrame:
    """Adds spans (with placeholders), found and redacted; the text stays as it is where nothing is found."""
    placed, n, out = _finish(text_col, tuple(settings.public_types))
    return detect(df, text_col, "spans", settings, rules, model).withColumn("spans", placed).withColumn("found", n).withColumn("redacted", out)


def exploded(df: DataFrame, *keys: str, spans: str = "spans") -> DataFrame:
    """One row per span, as ``s``.

    A plain explode makes the optimizer add a filter on the array's size and push the whole detection into it a
    second time; an outer one does not.
    """
    return df.select(*keys, F.explode_outer(spans).alias("s")).filter(F.col("s").isNotNull())


def report(redacted_df: DataFrame, *keys: str) -> DataFrame:
    """One row per span, public ones too, without any raw text."""
    return exploded(redacted_df, *keys).select(*keys, "s.placeholder", "s.entity_type", "s.start", "s.end", "s.confidence", "s.source")


def report_json(redacted_df: DataFrame, path_col: str, text_col: str = "text") -> DataFrame:
    """The report as one JSON text a row."""
    entities = F.transform("spans", lambda s: F.struct(*[s[k].alias(k) for k in ("placeholder", "entity_type", "start", "end", "confidence", "source")]))
    body = F.struct(F.col(path_col).alias("original_path"), F.sha2(F.col(text_col), 256).alias("content_hash"), "found", entities.alias("entities"))
    return redacted_df.select(path_col, F.to_json(body).alias("report"))


def counts_by_type(redacted_df: DataFrame, public: tuple[str, ...]) -> DataFrame:
    """Spans per non-public type."""
    rows = report(redacted_df).filter(~F.col("entity_type").isin(*public))
    return rows.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
