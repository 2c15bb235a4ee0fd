"""Every registered filing query against its SQL on the smallest test data."""

import duckdb
import pytest

import __spark_entry__ as entry
from tomeloom.plans.oracles import ORACLE_SQL
from tomeloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, order):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[i] for i in order)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = plain(df.collect(), sorted(range(len(df.columns)), key=lambda i: df.columns[i]))
    if name not in ORACLE_SQL:
        assert got
        return
    rel = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert got == plain(rel.fetchall(), sorted(range(len(names)), key=lambda i: names[i]))


def test_fuzzy_finds_what_exact_finds(spark):
    exact = QUERIES["align_cursor"](spark, SF).where("start IS NOT NULL").count()
    assert QUERIES["align_fuzzy"](spark, SF).where("start IS NOT NULL").count() >= exact * 0.9


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["extraction", "item_details"])
def test_extraction_segments_each_filing_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("explode(array(struct(heading") <= 1
    assert "locate" not in plan  # places that nobody reads


def test_filings_are_written_without_whole_stage_code(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from tomeloom.plans import corpus

    seen, name, write = [], "spark.sql.codegen.wholeStage", DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (seen.append(spark.conf.get(name)), write(self, *a, **b))[1])
    before = spark.conf.get(name)
    (tmp_path / "documents.parquet").symlink_to(f"{SF}/documents.parquet")
    assert corpus.filings(spark, str(tmp_path)).count() > 0
    assert seen == ["false"] and spark.conf.get(name) == before
