"""Money and text scalars as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.schemas import DEFAULT_MINOR_UNIT, MINOR_UNITS

PLAIN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
#: Amounts are usable below this.
LIMIT = 10**12


def stripped(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def to_decimal(text: Column) -> Column:
    """Strict plain decimal after a strip, else null: no exponent, no sign of currency, no grouping."""
    t = stripped(text)
    return F.when(t.rlike(PLAIN), t.try_cast("decimal(38,6)"))


def usable(amount: Column) -> Column:
    return F.when(F.abs(amount) < F.lit(LIMIT), amount)


def minor_units(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MINOR_UNITS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.upper(stripped(code))), F.lit(DEFAULT_MINOR_UNIT))


def currency_key(code: Column) -> Column:
    """Group key of a currency: stripped, upper case, blank or null as unknown."""
    return F.coalesce(F.nullif(F.upper(stripped(code)), F.lit("")), F.lit("unknown currency"))


def fits_minor_unit(amount: Column, n: int) -> Column:
    return amount == F.round(amount, n)


def plain_string(amount: Column, n: int) -> Column:
    """Digits padded to n places, further digits kept, no superfluous zero beyond, never minus zero."""
    text = F.regexp_replace(amount.cast("decimal(38,6)").cast("string"), rf"(\.\d{{{n}}}\d*?)0+$" if n else r"(\.\d*?)0+$", "$1")
    text = F.regexp_replace(text, r"\.$", "")
    return F.regexp_replace(text, r"^-(0(\.0*)?)$", "$1")


def field_of(path: Column) -> Column:
    """The field a path belongs to: what stands before the first dot or bracket."""
    return F.regexp_extract(path, r"^[^.\[]+", 0)


def model_cost(inp: Column, write: Column, read: Column, out: Column, price_in: float, price_out: float, read_share: float = 0.1) -> Column:
    """Price of a call: cache writes cost 1.25 times, cache reads read_share times the price of input; prices a million."""
    d = lambda x: F.lit(str(x)).cast("decimal(12,4)")
    used = inp.cast("decimal(18,2)") + write.cast("decimal(18,2)") * d(1.25) + read.cast("decimal(18,2)") * d(read_share)
    return ((used * d(price_in) + out.cast("decimal(18,2)") * d(price_out)) / F.lit(1_000_000)).cast("decimal(18,6)")


def escape_markup(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def words_contain(text: Column, quote: Column) -> Column:
    """Whether quote stands in text as whole words, white space collapsed on both sides."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.concat(F.lit(" "), flat(text), F.lit(" ")).contains(F.concat(F.lit(" "), flat(quote), F.lit(" ")))


def iso_date(text: Column) -> Column:
    """A YYYY-MM-DD calendar day, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
