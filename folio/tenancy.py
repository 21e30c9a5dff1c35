"""Tenant scopes: every read of a content table goes through one, and without one it fails."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.schemas import TABLES


class TenantScopeError(RuntimeError):
    """A content table was asked for outside a tenant's scope."""


class TenantScope:
    """Content tables of one organization. base holds a Parquet table per name (partition it by organization_id: the
    filter then prunes)."""

    def __init__(self, spark: SparkSession, base: str, organization_id: str | None):
        if not organization_id:
            raise TenantScopeError("no organization is bound")
        self.spark, self.base, self.organization_id = spark, base.rstrip("/"), organization_id

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise TenantScopeError(f"{name} is not a content table")
        df = self.spark.read.schema(TABLES[name]).parquet(f"{self.base}/{name}")
        return df.where(F.col("organization_id") == self.organization_id)


class QueueScope:
    """All organizations' jobs, and nothing else."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def table(self, name: str) -> DataFrame:
        if name != "jobs":
            raise TenantScopeError(f"the queue has no {name}")
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.base}/{name}")


def assert_scoped(df: DataFrame, organization_id: str) -> None:
    """Raises unless each scan of a content table in df's plan stands under a filter on this organization: the plan is walked, and a
    filter counts for the scan whose column it names, wherever else it is named."""
    test = re.compile(rf"\(organization_id#(\d+) = {re.escape(organization_id)}\)")

    def walk(node, bound: frozenset[str]) -> None:
        if node.nodeName() == "Filter":
            condition = node.condition().toString()
            if " OR " not in condition and "NOT " not in condition:
                bound |= {m[1] for m in test.finditer(condition)}
        kids = node.children()
        if kids.size() == 0:
            own = re.findall(r"organization_id#(\d+)", node.output().mkString(" "))
            if not bound.issuperset(own):
                raise TenantScopeError(f"a scan isn't filtered on {organization_id}")
        for i in range(kids.size()):
            walk(kids.apply(i), bound)

    walk(df._jdf.queryExecution().analyzed(), frozenset())
