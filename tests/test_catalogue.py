"""Every query of the catalogue against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from folio.plans import catalogue, document_model, documents, evaluation, intake, operations

QUERIES, ORACLE = catalogue.QUERIES | documents.QUERIES | document_model.QUERIES | evaluation.QUERIES | intake.QUERIES | operations.QUERIES, catalogue.ORACLE | documents.ORACLE | document_model.ORACLE | evaluation.ORACLE | intake.ORACLE | operations.ORACLE

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and hasattr(v, "__len__") and not isinstance(v, str)):
        return str([shown(x) for x in v])
    if pd.isna(v):
        return "~"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 9))
    return str(v)


def rows(frame, columns):
    return sorted(tuple(map(shown, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), con.execute(ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_documents_without_sql(spark):
    from folio.functions import masking, printed

    for r in documents.sc_printed_amounts(spark, DIR).join(documents.pii_masked(spark, DIR), "doc_id").join(spark.read.parquet(f"{DIR}/documents.parquet"), "doc_id").collect():
        assert r["amounts"] == [format(x, "f") for x in printed.printed_amounts(r["text"], 2)]
        assert r["hidden"] == (masking.mask_cards(r["text"]) != r["text"])
    events = spark.read.parquet(f"{DIR}/events.parquet").count()
    assert documents.str_limiter_replay(spark, DIR).count() == documents.str_job_replay(spark, DIR).count() == events


def test_no_python_in_native_plans(spark):
    for name in ("fq_currency_totals", "ag_daily_metrics", "hyb_rrf", "rcl_status_fold"):
        plan = catalogue.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_entry_without_llm(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
