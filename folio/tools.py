"""The engine's functions as tools: named, with checked arguments, clamped limits and errors as results; and as SQL functions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date
from inspect import signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import masking
from folio.functions import text as T
from folio.operators import records as C
from folio.operators import search as S


def _day(text: str) -> bool:
    try:
        return bool(re.fullmatch(r"\d{4}-\d\d-\d\d", text, re.A)) and bool(date.fromisoformat(text))
    except ValueError:
        return False


#: What texts must look like, by argument: amounts of a record, and days.
AMOUNT = (lambda text: bool(re.fullmatch(r"[+-]?(\d{1,32}(\.\d{1,6})?|\.\d{1,6})", text.strip(), re.A)), "a plain decimal number")
PATTERNS = {"total_min": AMOUNT, "total_max": AMOUNT, "date_from": (_day, "a day, as YYYY-MM-DD"), "date_to": (_day, "a day, as YYYY-MM-DD")}


@dataclass(frozen=True)
class Result:
    """Rows, or what was wrong with the call."""

    rows: DataFrame | None = None
    error: str | None = None


@dataclass
class Tools:
    """A registry of tools over one set of tables."""

    tables: dict[str, DataFrame]
    known: dict[str, tuple[dict[str, type], Callable[..., Result]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.known |= {
            "query_extractions": ({"vendor": str, "currency": str, "date_from": str, "date_to": str, "total_min": str, "total_max": str}, self.query_extractions),
            "search_documents": ({"query_table": str, "mode": str, "k": int}, self.search_documents),
            "get_page": ({"document_id": str, "page_number": int}, self.get_page),
        }

    def call(self, name: str, arguments: dict) -> Result:
        """Runs a tool. An unknown tool, an argument it doesn't have and one of another type are errors, not exceptions."""
        if name not in self.known:
            return Result(error=f"no tool {name}")
        types, run = self.known[name]
        for key, value in arguments.items():
            if key not in types:
                return Result(error=f"{name} has no argument {key}")
            if value is not None and (not isinstance(value, types[key]) or isinstance(value, bool)):
                return Result(error=f"{key} must be of type {types[key].__name__}")
            if value is not None and key in PATTERNS and not PATTERNS[key][0](value):
                return Result(error=f"{key} must be {PATTERNS[key][1]}")
        missing = [p.name for p in signature(run).parameters.values() if p.default is p.empty and arguments.get(p.name) is None]
        if missing:
            return Result(error=f"{name} needs {', '.join(missing)}")
        return run(**arguments)

    def query_extractions(self, vendor=None, currency=None, date_from=None, date_to=None, total_min=None, total_max=None) -> Result:
        latest = C.latest_extractions(self.tables["documents"], self.tables["extractions"])
        found = C.matching(C.facts(latest, self.tables["fields"]), C.Question(vendor, currency, date_from, date_to, total_min, total_max))
        return Result(C.totals(found))

    def search_documents(self, query_table: str = "queries", mode: str = "hybrid", k: int = 5) -> Result:
        if query_table not in self.tables or mode not in ("dense", "lexical", "hybrid"):
            return Result(error=f"no queries {query_table}, or no mode {mode}")
        return Result(S.search(self.tables["chunks"], self.tables[query_table], mode, max(1, min(10, k))))

    def get_page(self, document_id: str, page_number: int) -> Result:
        """The page's lines, card numbers masked, with their spans in the page."""
        pages = self.tables["pages"].where(F.col("document_id") == document_id)
        last = pages.agg(F.max("page_number")).first()[0]
        if last is None:
            return Result(error=f"no document {document_id}")
        if not 1 <= page_number <= last:
            return Result(error=f"{document_id} has pages 1 to {last}")
        lines = pages.where(F.col("page_number") == page_number).withColumn("text", masking.masked_cards(F.col("text"))).withColumn("x", F.explode(T.line_spans(F.col("text"))))
        return Result(lines.select("document_id", "page_number", F.col("x.s").alias("char_start"), F.col("x.e").alias("char_end"), F.expr("substring(text, x.s + 1, x.e - x.s)").alias("line")))


class UnknownKind(ValueError):
    """A job's kind has no handler: it fails for good, and isn't tried again."""


class Handlers:
    """What runs for each kind of job."""

    def __init__(self, handlers: dict[str, Callable[[dict], object]]):
        self.handlers = dict(handlers)

    def __call__(self, kind: str, job: dict) -> object:
        if kind not in self.handlers:
            raise UnknownKind(kind)
        return self.handlers[kind](job)


def sql_functions(spark: SparkSession, costs: str) -> None:
    """Session functions over a view of costs (organization_id, at, cost): current_organization() reads the session variable of that
    name, spend_since(t) is that organization's spend, all_spend_since(t) one number over all of them."""
    spark.sql("DECLARE OR REPLACE VARIABLE organization STRING DEFAULT NULL")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION current_organization() RETURNS STRING RETURN session.organization")
    total = f"SELECT coalesce(sum(c.cost), 0) FROM {costs} c WHERE c.at >= since"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION all_spend_since(since TIMESTAMP) RETURNS DECIMAL(38,6) RETURN ({total})")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION spend_since(since TIMESTAMP) RETURNS DECIMAL(38,6) RETURN ({total} AND c.organization_id = session.organization)")
