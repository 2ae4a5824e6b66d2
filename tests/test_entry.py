"""The entry point, and that the engine stands without the training-data operators."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry
from quillveil.plans import registry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert registry.FLAGSHIP in entry.queries()


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 200 and set(rows[0].asDict()) == {"doc_id", "found", "redacted_sha256"}


def test_engine_does_not_import_the_operators():
    code = "import quillveil.plans.registry, quillveil.streaming.job, sys; assert not [m for m in sys.modules if m.startswith('quillveil.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True)


@pytest.mark.parametrize("hidden", ["public_tokenizers", "quillveil.llm", "corpus_pipeline"])
def test_engine_stands_where_an_import_fails(hidden):
    """A hidden module is one that import finds none of; the engine's queries stay."""
    code = f"""
import sys
sys.modules["{hidden}"] = None
import __spark_entry__ as e
from quillveil.plans import registry
assert set(registry.QUERIES) <= set(e.queries()) and set(registry.ORACLES) <= set(e.oracle_sql())
assert "{hidden}" == "corpus_pipeline" or not any(q.startswith("op1_") for q in e.queries())
assert "pipeline" not in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], check=True)


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    result = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    assert got == sorted(str(tuple(r[names.index(c)] for c in cols)) for r in result.fetchall())


@pytest.mark.parametrize(
    "texts, want",
    [
        (["innt 4665471787434696 86.227.24.100 an this"], (1, 0)),  # the card's match ran on into the address: never hidden
        (["innt 4665471787434696, and 4665471787434696 86.227.24.100"], (2, 1)),  # a hidden card that stands there once more
        ([], (0, 0)),
    ],
)
def test_a_leak_is_a_hidden_value_found_again(spark, tmp_path, texts, want):
    import duckdb

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in registry.QUERIES["no_leak"](spark, str(tmp_path)).collect()] == [want]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.execute(registry.ORACLES["no_leak"]).fetchall()
    assert sql == [(want[0], 0)]  # the SQL states that nothing leaks, it does not look
