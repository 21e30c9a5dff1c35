"""A corpus pipeline of five stages over documents: language, near duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, with the types
that came in, extra columns and clashing names included. run() writes a stage's rows to the shared folder, reads them back
as the next stage's docs, and deletes them once the stage after has been written.

Cases, by stage (each is judged on its own input):
- null or letterless text: rejected by the language stage; later stages, run on their own, keep it (it has no shingles, no words,
  no spans and no tokens).
- null doc_id: a document like any other; the language model does not learn from it; in the near-duplicate stage it counts
  after all documents with an id; a contaminated one goes.
- repeated rows: judged alike, so they stay or go together, except that rows of one doc_id are one document in the
  near-duplicate and benchmark stages: all go if one of them goes.
- ties: of equal or linked documents the smallest doc_id stays.
- empty tables: no labelled document means that every document is rejected; an empty benchmark contaminates nothing; empty
  documents give empty results of the same columns.
- very long texts are read whole by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import bpe, decontaminate, jaccard, langid, secrets
from folio.llm.common import forget, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model, fitted on these documents, doesn't reject."""
    return langid.filtered(docs, langid.fit(langid.learn_from(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (that of the smallest id) of each component of near copies: shingles of five words, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, jaccard.NEAR)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts that are left."""
    return bpe.digests(docs, *bpe.vocabulary())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secret_spans), ("tokens", tokens)]
#: BPE and fitted models can't be put in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
