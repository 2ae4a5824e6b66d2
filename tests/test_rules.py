"""Rules against Python's own engine, and the span algebra."""

import random
import re

from pyspark.sql import functions as F

from quillveil.operators import redact as r
from quillveil.operators import spans as sp
from quillveil.operators.rules import RULES
from quillveil.plans import fixtures
from quillveil.runtime import table
from quillveil.schema import Settings

SPAN = "start int, end int, entity_type string, text string, confidence double, source string, rank int"


def python_matches(rule, text):
    pattern = re.compile(rule.pattern, re.I if rule.any_case else 0)
    return [m.span(rule.group) for m in pattern.finditer(text)]


TEXTS = [t for _, t, _ in fixtures.RULE_CASES] + [
    "Full Legal Name Ann Poe Date of Birth 03/04/1985 SSN 458-02-6841 Username annpoe_85 Temporary Password Blue Sky 22 API Key abcd1234efgh5678ijkl Security Answer my first cat Health Plan Gold 500 Member ID XQ12345 Primary Physician Dr. Lee Blood Type O positive Condition mild asthma Medication Albuterol Recent Visit Jan 3, 2024 Clinic North Side Verification PIN 99321\n",
    "Password correct horse battery\nUsername someone_else\r\nCondition: stable angina Medication: aspirin daily",
    "１２３-４５-６７８９ and 212 555 0187 and ５５５ 0187 x Password abcdefg more\nend",
    "password: 'quoted value' token='abcdefghijABCDEFGHIJ0123456789' pwd=\"zzzzzzzzzzzzzzzzzzzzzzzz",
    "12 Long Winding River Road, Apt 4B and 99 Id Street and 7 phone Lane 8 St. 9 Ave",
]


def test_every_rule_matches_as_python_does(spark, sf):
    rows = TEXTS + [x.text for x in table(spark, sf, "documents").collect()] + [x.html for x in table(spark, sf, "pages").limit(20).collect()]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    for at in range(0, len(RULES), 10):
        rules = RULES[at : at + 10]
        bare = [type(x)(**{**x.__dict__, "check": None, "gate": (), "shape": ""}) for x in rules]
        got = df.select("i", *[sp.matches(F.col("t"), sp._record(x, k)).alias(f"r{k}") for k, x in enumerate(bare)]).collect()
        for row in got:
            for k, rule in enumerate(rules):
                assert [(s.start, s.end) for s in row[f"r{k}"]] == python_matches(rule, rows[row.i]), (rule.pattern, rows[row.i][:200])


def test_gates_change_nothing(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    bare = tuple(type(x)(**{**x.__dict__, "gate": (), "shape": ""}) for x in RULES)
    gated, free = (df.select("i", sp.candidates(F.col("t"), x).alias("c")).collect() for x in (RULES, bare))
    assert gated == free and any(x.c for x in gated)


def test_fixture_values(spark):
    df = spark.createDataFrame([(c, t) for c, t, _ in fixtures.RULE_CASES], "c string, text string")
    got = {x.c: tuple((s.entity_type, s.text) for s in x.spans) for x in r.detect(df).collect()}
    assert got == {c: w for c, _, w in fixtures.RULE_CASES}


def brute_accept(spans, key):
    taken = []
    for _, s in sorted(enumerate(spans), key=lambda x: (key(x[1]), x[0])):
        if not any(s[0] < t[1] and t[0] < s[1] for t in taken):
            taken.append(s)
    return sorted(taken, key=lambda s: (s[0], s[1]))


def random_spans(rng):
    out = []
    for _ in range(rng.randint(0, 14)):
        a = rng.randrange(40)
        out.append((a, a + rng.randint(1, 9), rng.choice("ABC"), "x", rng.choice([0.5, 0.75, 1.0]), rng.choice(["regex", "custom", "model", "propagated"]), rng.randrange(4)))
    return out


def test_greedy_resolution_brute_force(spark):
    rng = random.Random(7)
    rows = [random_spans(rng) for _ in range(150)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, s array<struct<{SPAN.replace(' int', ':int').replace(' string', ':string').replace(' double', ':double')}>>")
    got = df.select("i", sp.resolve(F.col("s")).alias("a"), sp.resolve_tier(F.col("s")).alias("b"), sp.merge(F.col("s")).alias("c")).collect()
    length = lambda s: s[0] - s[1]
    for row in got:
        x = rows[row.i]
        assert [tuple(s)[:3] for s in row.a] == [s[:3] for s in brute_accept(x, lambda s: (length(s), s[6]))]
        assert [tuple(s)[:3] for s in row.b] == [s[:3] for s in brute_accept(x, lambda s: (s[5] != "regex", length(s), -s[4]))]
        assert [tuple(s)[:3] for s in row.c] == [s[:3] for s in brute_accept(x, lambda s: (s[5] not in ("regex", "custom"), length(s), -s[4], s[0]))]


def test_mask_keeps_length_and_clamps(spark):
    df = spark.createDataFrame([("a😀cdef", [(1, 3, "A", "", 1.0, "regex", 0), (5, 99, "A", "", 1.0, "regex", 0), (-2, 0, "A", "", 1.0, "regex", 0)])], f"t string, s array<struct<{SPAN.replace(' int', ':int').replace(' string', ':string').replace(' double', ':double')}>>")
    assert df.select(sp.mask(F.col("t"), F.col("s"))).first()[0] == "a██de█"


def test_placeholders_number_values_without_case(spark):
    text = "a@b.com then c@d.com then A@B.COM and https://x.example/ and a@b.com"
    row = r.redact(spark.createDataFrame([(text,)], "text string")).first()
    assert row.redacted == "[EMAIL_1] then [EMAIL_2] then [EMAIL_1] and https://x.example/ and [EMAIL_1]"
    assert row.found == 4 and [s.placeholder for s in row.spans] == ["[EMAIL_1]", "[EMAIL_2]", "[EMAIL_1]", "[URL_1]", "[EMAIL_1]"]


def test_redaction_is_disjoint_idempotent_and_leak_free(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = r.redact(docs).collect()
    for x in rows:
        assert all(a.end <= b.start for a, b in zip(x.spans, x.spans[1:])) and all(x.text[s.start : s.end] == s.text for s in x.spans)
    again = r.redact(spark.createDataFrame([(x.doc_id, x.redacted) for x in rows], "doc_id long, text string"))
    assert again.agg(F.sum("found")).first()[0] == 0


def test_empty_and_null_texts(spark):
    rows = r.redact(spark.createDataFrame([(1, None), (2, "")], "i int, text string")).collect()
    assert [(x.found, x.redacted, x.spans) for x in rows] == [(0, "", [])] * 2


def test_keywords_lose_to_rules_and_keep_word_borders(spark):
    df = spark.createDataFrame([("Project X1 mailed a@b.com; projectx1 PROJECT X1 \\E(",)], "text string")
    row = r.redact(df, settings=Settings(custom_keywords=("project x1", "mailed a@b.com", "\\E(", " "))).first()
    assert [(s.entity_type, s.text) for s in row.spans] == [("CUSTOM", "Project X1"), ("EMAIL", "a@b.com"), ("CUSTOM", "PROJECT X1"), ("CUSTOM", "\\E(")]


def test_model_tier_masks_merges_and_propagates(spark):
    seen = []

    def model(df, masked, out):
        seen.append(df.select(masked).first()[0])
        span = "named_struct('start', 4, 'end', 10, 'entity_type', 'SURNAME', 'text', '', 'confidence', 0.9D, 'source', 'model', 'rank', 0)"
        clash = "named_struct('start', 12, 'end', 20, 'entity_type', 'CITY', 'text', '', 'confidence', 0.9D, 'source', 'model', 'rank', 0)"
        return df.withColumn(out, F.expr(f"array({span}, {clash})"))

    df = spark.createDataFrame([("Mr. Garcia, a@b.com and garcia; garcias",)], "text string")
    row = r.redact(df, settings=Settings(enable_model=True), model=model).first()
    assert seen == ["Mr. Garcia, ███████ and garcia; garcias"]
    assert row.redacted == "Mr. [SURNAME_1], [EMAIL_1] and [SURNAME_1]; garcias"
    assert [s.source for s in row.spans] == ["model", "regex", "propagated"]
    assert r.redact(df, settings=Settings(enable_model=True, propagate=False), model=model).first().redacted.count("[SURNAME_1]") == 1


def test_report_has_no_raw_text(spark):
    out = r.redact(spark.createDataFrame([("/a/b.txt", "mail a@b.com")], "path string, text string"))
    assert "text" not in r.report(out, "path").columns and "a@b.com" not in r.report_json(out, "path").first().report
