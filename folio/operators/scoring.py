"""Scores of extracted fields against gold: one match rule per field, hallucinations, misses, schema violations, rows.

Rules are Columns over text; only the likeness of two strings needs Python, and gets it in Arrow batches after equal and
empty pairs were settled without it.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from folio.functions.money import stripped, to_decimal

# Thresholds, the tolerance of an amount, filler words of payment terms.
NAME_LIKE, DESCRIPTION_LIKE = 0.85, 0.80
TOLERANCE = "0.01"
FILLER = ("terms", "days")


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all characters, by longest matching blocks."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def folded(text: Column) -> Column:
    """Lower case, punctuation as blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def fuzzy(gold: Column, found: Column, threshold: float) -> Column:
    a, b = folded(gold), folded(found)
    return F.when(a == b, F.lit(True)).otherwise(likeness(a, b) >= threshold)


def identifier(gold: Column, found: Column) -> Column:
    """Letters and digits alone decide; a gold without any matches nothing."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"(?U)[\W_]", "")
    return (bare(gold) != "") & (bare(gold) == bare(found))


def calendar_day(text: Column) -> Column:
    """ISO, Y/M/D, M/D/Y, and D/M/Y where the month can't be one; null for anything else."""
    t = stripped(text)
    part = lambda i: F.regexp_extract(t, r"^(\d{1,4})/(\d{1,2})/(\d{1,4})$", i)
    day = lambda y, m, d: F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    slashed = F.when(F.length(part(1)) == 4, day(part(1), part(2), part(3))).when(part(1).try_cast("int") > 12, day(part(3), part(2), part(1))).otherwise(day(part(3), part(1), part(2)))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date")).when(t.rlike(r"^\d{1,4}/\d{1,2}/\d{1,4}$"), slashed)


def dates(gold: Column, found: Column) -> Column:
    return F.coalesce(calendar_day(gold) == calendar_day(found), F.lit(False))


def currencies(gold: Column, found: Column) -> Column:
    return F.upper(F.trim(gold)) == F.upper(F.trim(found))


def exact(gold: Column, found: Column) -> Column:
    return F.trim(gold) == F.trim(found)


def terms(gold: Column, found: Column) -> Column:
    """The gold's words stand in the found text as an unbroken run, or both have the same numbers and are alike."""
    words = lambda c: F.filter(F.split(folded(c), " "), lambda w: (w != "") & ~w.isin(*FILLER))
    joined = lambda c: F.array_join(words(c), " ")
    numbers = lambda c: F.filter(words(c), lambda w: w.rlike(r"\d"))
    run = F.concat(F.lit(" "), joined(found), F.lit(" ")).contains(F.concat(F.lit(" "), joined(gold), F.lit(" ")))
    return (F.size(words(gold)) > 0) & (run | ((numbers(gold) == numbers(found)) & (likeness(joined(gold), joined(found)) >= NAME_LIKE)))


def amounts(gold: Column, found: Column) -> Column:
    return F.coalesce(F.abs(to_decimal(gold) - to_decimal(found)) <= F.lit(TOLERANCE).cast("decimal(4,2)"), F.lit(False))


def rates(gold: Column, found: Column) -> Column:
    return F.coalesce(to_decimal(gold) == to_decimal(found), F.lit(False))


Rule = Callable[[Column, Column], Column]
#: The rule of each field; fields of kind money go by amounts.
RULES: dict[str, Rule] = {
    "vendor": lambda g, f: fuzzy(g, f, NAME_LIKE), "payment_method": lambda g, f: fuzzy(g, f, NAME_LIKE), "description": lambda g, f: fuzzy(g, f, DESCRIPTION_LIKE),
    "invoice_number": identifier, "po_number": identifier, "vendor_tax_id": identifier, "document_date": dates, "due_date": dates, "payment_terms": terms,
    "payment_card_last4": exact, "currency": currencies, "rate": rates,
}


def scored(pairs: DataFrame) -> DataFrame:
    """pairs (field, gold, found, quoted) with correct, hallucinated and violated. Both null is correct; a value where gold
    has none is a hallucination; null where gold has a value is wrong. quoted: found was text in the JSON, which violates the
    schema of an amount even if it matches. Fields without a rule are amounts."""
    gold, found, name = F.col("gold"), F.col("found"), F.col("field")
    match = None
    for rule in dict.fromkeys(RULES.values()):
        fields = [f for f, r in RULES.items() if r is rule]
        match = (F.when if match is None else match.when)(name.isin(*fields), rule(gold, found))
    match = match.otherwise(amounts(gold, found))
    correct = F.when(gold.isNull() & found.isNull(), F.lit(True)).when(gold.isNull() | found.isNull(), F.lit(False)).otherwise(match)
    amount = ~name.isin(*(set(RULES) - {"rate"}))
    return pairs.withColumns({"correct": F.coalesce(correct, F.lit(False)), "hallucinated": gold.isNull() & found.isNotNull(), "violated": amount & found.isNotNull() & F.coalesce(F.col("quoted"), F.lit(False))})


def row_accuracy(cells: DataFrame, key: str) -> DataFrame:
    """Per document: rows paired by position whose cells all match, over the longer list's length; two empty lists (all cells
    null, position null) give 1. cells: key, position, correct."""
    rows = cells.groupBy(key, "position").agg(F.bool_and("correct").alias("row_correct"))
    counted = rows.groupBy(key).agg(F.count("position").alias("n"), F.count_if(F.col("row_correct") & F.col("position").isNotNull()).alias("matched"))
    return counted.select(key, "n", "matched", F.when(F.col("n") == 0, 1.0).otherwise(F.col("matched") / F.col("n")).alias("accuracy"))
