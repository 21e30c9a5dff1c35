"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import bpe, chat, decontaminate, jaccard, langid, negatives, neighbours, repeats, secrets, spelling, tokencount, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1_bpe,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_jaccard": jaccard.op3_jaccard,
    "op4_secrets": secrets.op4_secrets,
    "op5_chat": chat.op5_chat,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_warc": warc.op7_warc,
    "op8_langid": langid.op8_langid,
    "op9_token_counts": tokencount.op9_token_counts,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_spelling": spelling.op11_spelling,
    "op12_substrings": repeats.op12_substrings,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}
ORACLE: dict[str, str] = jaccard.ORACLE | chat.ORACLE | warc.ORACLE | decontaminate.ORACLE | spelling.ORACLE | repeats.ORACLE | negatives.ORACLE
