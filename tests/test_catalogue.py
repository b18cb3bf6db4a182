"""Every registered query against its SQL on the smallest tables, and the driver's contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from evidentia import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(spark, duck, query, sql):
    df = query(spark, SF)
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    same(spark, duck, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_payload_round_trip(spark):
    found = catalogue.queries()["qr_payload_inflate"](spark, SF)
    assert found.count() and not found.where("NOT same OR NOT decoded").count()


def test_contract(spark):
    assert entry.entry(spark).columns == ["identity_id", "risk_score", "risk_level", "reasons", "document_hash"]
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_nothing_else_imports_the_llm_folder():
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for d, _, files in os.walk(os.path.join(top, "evidentia")):
        if os.path.basename(d) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(d, f)) as text:
                    assert "evidentia.llm" not in text.read(), f
