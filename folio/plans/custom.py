"""Queries that SQL can't express, held against brute force by tests; and second names (in _all) of queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.plans import catalogue as C


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-boundary chunks of every whole document."""
    pages = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return T.chunks(pages).drop("text")


def emb_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashing embeddings of the benchmark passages."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return rows.select("item_id", T.embedder()("text").alias("embedding"))


QUERIES = {"chunk_pages": chunk_pages, "emb_hash": emb_hash}


def txt_long_line_windows_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of every non-empty text, whatever its length."""
    return C.line_windows(C.Tables(spark, sf_dir).documents)


QUERIES |= {"txt_long_line_windows_all": txt_long_line_windows_all}


def set_ordered_dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered de-dup of the words of every text that isn't null."""
    return C.ordered_dedup(C.Tables(spark, sf_dir).documents.where("text is not null"))


QUERIES |= {"set_ordered_dedup_all": set_ordered_dedup_all}


#: The query set of searches: ids divisible by this.
EVERY = 20


def vec_cosine_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.nearest(C.Tables(spark, sf_dir), 10, EVERY).select("query_id", "id", "rank", "sim")


def hyb_rrf_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fused(C.Tables(spark, sf_dir), EVERY).select("query_id", "id", F.round("score", 9).alias("score"), "position")


def hyb_collapse_docs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fused(C.Tables(spark, sf_dir), EVERY).groupBy("query_id", (F.col("id") % 100).alias("doc")).agg(F.min("position").alias("position"))


def ev_recall_mrr_ndcg_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.metrics(C.Tables(spark, sf_dir), EVERY).select("query_id", *(F.round(c, 9).alias(c) for c in ("recall", "rr", "ndcg")))


def ev_hardest10_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.metrics(C.Tables(spark, sf_dir), EVERY).select("query_id", F.round("rr", 9).alias("rr")).orderBy("rr", "query_id").limit(10)


QUERIES |= {f.__name__: f for f in (vec_cosine_topk_all, hyb_rrf_all, hyb_collapse_docs_all, ev_recall_mrr_ndcg_all, ev_hardest10_all)}


def rcl_failing_checks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failing checks of all lines of each order."""
    return C.failing_checks(C.Tables(spark, sf_dir))


def jn_positional_zip_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.QUERIES["jn_positional_zip"](spark, sf_dir)


QUERIES |= {"rcl_failing_checks_all": rcl_failing_checks_all, "jn_positional_zip_all": jn_positional_zip_all}

#: The SQL of the queries that have a second name.
ORACLE = {name: C.ORACLE[name.removesuffix("_all")] for name in QUERIES if name.endswith("_all")}
