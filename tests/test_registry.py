"""Every query with SQL gives DuckDB's rows on the smallest data set; the others give rows."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from orbweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v
    return sorted((tuple(clean(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    got = registry.QUERIES[name](spark, sf)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["word", "occurrences", "desvio_padrao"] and frame.count() > 0


def test_names():
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(registry.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_optional_parts_may_be_absent(monkeypatch):
    import importlib

    real = importlib.import_module

    def without(name, *more):
        if name.startswith("orbweave.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *more)

    monkeypatch.setattr(importlib, "import_module", without)
    assert set(__spark_entry__.queries()) == set(registry.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(registry.ORACLE_SQL)


def test_nothing_else_imports_the_optional_part():
    import pathlib
    import re

    root = pathlib.Path(registry.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path


def test_fits_hold_all_users(spark, sf):
    users = {r["user"] for r in registry.QUERIES["spin_means"](spark, sf).collect()}
    n = len(users)
    fields = [r["i"] for r in registry.QUERIES["ising_pseudo"](spark, sf).collect() if r["i"] == r["j"]]
    assert n > 8 and len(fields) == n and set(fields) == users
    assert {r["error"] or len(r["parameters"]) for r in registry.QUERIES["ising_mch"](spark, sf).collect()} == {n + n * (n - 1) // 2}
    assert registry.QUERIES["ising_comparison"](spark, sf).head()["N"] == n


def test_fits_hold_all_keywords(spark, sf):
    n = registry.QUERIES["word_interval_std"](spark, sf).where("desvio_padrao <= 10000").count()
    assert n > 20 and registry.QUERIES["ising_comparison"](spark, sf).head()["R"] == n
