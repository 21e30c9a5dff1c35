import pytest

from folio.tenancy import QueueScope, TenantScope, TenantScopeError, assert_scoped


def test_scopes(spark, tmp_path):
    from folio.schemas import TABLES

    rows = spark.createDataFrame([("acme", "1", "open"), ("other", "2", "open")], "organization_id string, id string, state string")
    for name in ("documents", "jobs"):
        rows.write.parquet(f"{tmp_path}/{name}")
    scope = TenantScope(spark, str(tmp_path), "acme")
    df = scope.table("documents")
    assert [r["id"] for r in df.collect()] == ["1"] and len(df.columns) == len(TABLES["documents"].split(", "))
    assert_scoped(df, "acme")
    raw = spark.read.schema(TABLES["documents"]).parquet(f"{tmp_path}/documents")
    with pytest.raises(TenantScopeError):
        assert_scoped(raw.select("id", "organization_id"), "acme")
    # two filters on one scan don't excuse another; an alternative is no filter; a join of scoped tables is fine
    for bad in (df.where("organization_id = 'acme'").unionAll(raw), raw.where("organization_id = 'acme' or id = '2'"), df.join(raw.select("id"), "id")):
        with pytest.raises(TenantScopeError):
            assert_scoped(bad, "acme")
    assert_scoped(df.join(scope.table("jobs").select("id"), "id"), "acme")
    with pytest.raises(TenantScopeError):
        TenantScope(spark, str(tmp_path), None)
    with pytest.raises(TenantScopeError):
        scope.table("users")
    assert QueueScope(spark, str(tmp_path)).table("jobs").count() == 2
    with pytest.raises(TenantScopeError):
        QueueScope(spark, str(tmp_path)).table("documents")
