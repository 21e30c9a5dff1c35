"""Scalars about answers, names, times, keys and printed figures, as Column builders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import money as M

# Numbers in answers, figures that look like money, marks of citations, words of small numbers, the shape of an access
# key, an address's and a name's longest form, decimals of quantities and rates.
NUMBER = r"(?U)(?<![\w.,])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+[.,]\d{2}(?!\d)|\d+)(?![\w])"
MONEY = r"[$€£]\s?\d|\d\s?(?:USD|EUR|GBP)\b|\b(?:USD|EUR)\s?\d|\d+[.,]\d{2}(?!\d)"
MARKER = r"\s?\[\d+\]"
WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
KEY_PREFIX, KEY_SECRET = "[a-z2-7]{%d}", "[A-Za-z0-9_-]{43}"
LONGEST_ADDRESS, LONGEST_NAME = 254, 100
PLACES = 6
CENT = "0.01"


def numbers_in(answer: Column) -> Column:
    """The numbers that an answer states: a comma before two last digits is a decimal one, other commas group."""
    plain = lambda m: F.when(m.rlike(r"^\d+,\d{2}$"), F.translate(m, ",", ".")).otherwise(F.translate(m, ",", ""))
    return F.transform(F.regexp_extract_all(answer, F.lit(NUMBER), F.lit(1)), lambda m: plain(m).try_cast("decimal(38,6)"))


def states_number(answer: Column, expected: Column) -> Column:
    """Whether a number of the answer is within a cent of the expected one."""
    return F.exists(numbers_in(answer), lambda n: F.abs(n - expected) <= F.lit(CENT).cast("decimal(4,2)"))


def states_amount(answer: Column) -> Column:
    """Whether the answer holds any figure that looks like money."""
    return answer.rlike(MONEY)


def states_count(answer: Column, count: Column) -> Column:
    """Whether the answer says a count, in digits or, up to ten, in words."""
    word = F.try_element_at(F.array(*map(F.lit, WORDS)), (count + 1).cast("int"))
    said = F.exists(F.split(F.lower(answer), r"[^a-z]+"), lambda w: w == word)
    return F.exists(numbers_in(answer), lambda n: n == count) | F.coalesce(said, F.lit(False))


def date_forms(day: Column) -> Column:
    """The ways in which a day is written in answers."""
    number, month, short = F.dayofmonth(day).cast("string"), F.date_format(day, "MMMM"), F.date_format(day, "MMM")
    year = F.year(day).cast("string")
    join = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.array(day.cast("string"), join(month, " ", number, ", ", year), join(number, " ", month, " ", year), join(short, " ", number, ", ", year), join(month, " ", number), join(F.month(day).cast("string"), "/", number, "/", year), F.date_format(day, "MM/dd/yyyy"))


def states_date(answer: Column, day: Column) -> Column:
    return F.exists(date_forms(day), lambda form: F.lower(answer).contains(F.lower(form)))


def unmarked(answer: Column) -> Column:
    """An answer without citation marks, null if nothing is left."""
    return F.nullif(M.stripped(F.regexp_replace(answer, MARKER, "")), F.lit(""))


def input_amount(text: Column, places: Column | int = 2) -> Column:
    """value and problem of an amount that somebody typed: a plain decimal of at most so many decimals, under a limit."""
    return _input(text, places, F.lit(-M.LIMIT) < M.to_decimal(text), M.to_decimal(text) < F.lit(M.LIMIT), "too large")


def input_quantity(text: Column) -> Column:
    return _input(text, PLACES, F.lit(-M.LIMIT) < M.to_decimal(text), M.to_decimal(text) < F.lit(M.LIMIT), "too large")


def input_rate(text: Column) -> Column:
    """A printed percentage from 0 to 100."""
    return _input(text, PLACES, M.to_decimal(text) >= 0, M.to_decimal(text) <= 100, "not a rate between 0 and 100")


def _input(text: Column, places: Column | int, least: Column, most: Column, far: str) -> Column:
    value = M.to_decimal(text)
    digits = F.length(F.regexp_extract(M.stripped(text), r"\.(\d*?)0*$", 1))
    problem = F.when(value.isNull(), "not a plain number").when(digits > places, "too many decimal places").when(~(least & most), far)
    return F.struct(F.when(problem.isNull(), value).alias("value"), problem.alias("problem"))


def seconds_to_midnight(at: Column) -> Column:
    """Whole seconds until the next UTC midnight, at least one."""
    return F.greatest(F.lit(86_400) - F.pmod(F.unix_seconds(at), F.lit(86_400)), F.lit(1))


def iso_instant(text: Column) -> Column:
    """An instant in extended or basic ISO form; without a zone it is UTC; else null."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd'T'HH:mm:ss[XXX]", "yyyyMMdd'T'HHmmss[XXX]", "yyyyMMdd'T'HHmmss[X]")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in forms))


def slug(filename: Column) -> Column:
    """A file's stem in lower case, runs of anything but letters and digits as one dash; document if nothing is left."""
    base = F.regexp_extract(filename, r"([^/]*)$", 1)
    stem = F.lower(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""))
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(stem, r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit("")), F.lit("document"))


def numbered(label_ids: Column) -> Column:
    """One more than the largest three-digit number before a dash, over a group's ids."""
    return F.coalesce(F.max(F.nullif(F.regexp_extract(label_ids, r"^(\d{3})-", 1), F.lit("")).cast("int")), F.lit(0)) + 1


def key_prefix(token: Column, scheme: str, prefix: int) -> Column:
    """The public prefix of a token that has exactly an access key's shape, else null."""
    return F.nullif(F.regexp_extract(token, rf"\A{scheme}_({KEY_PREFIX % prefix})_{KEY_SECRET}\z", 1), F.lit(""))


def address(text: Column) -> Column:
    """A trimmed mail address with exactly one @, neither blanks nor control characters, of a bounded length; else null."""
    t = M.stripped(text)
    return F.when(t.rlike(r"\A[^@\p{C}\p{Z}]+@[^@\p{C}\p{Z}]+\z") & F.length(t).between(1, LONGEST_ADDRESS), t)


def clean_name(text: Column) -> Column:
    t = M.stripped(text)
    return F.when(F.length(t).between(1, LONGEST_NAME) & ~t.rlike(r"\p{C}"), t)


def figure(x: Column) -> Column:
    """About three significant places: 1,234 or 56.7 or 8.91."""
    return F.when(x >= 100, F.format_number(x, 0)).when(x >= 10, F.format_number(x, 1)).otherwise(F.format_number(x, 2))


def share(x: Column) -> Column:
    return F.concat(F.format_number(x * 100, 1), F.lit("%"))


def change(before: Column, after: Column) -> Column:
    moved = (after - before) / F.nullif(before, F.lit(0.0)) * 100
    return F.coalesce(F.concat(F.when(F.round(moved, 1) >= 0, "+").otherwise(""), F.format_number(moved, 1), F.lit("%")), F.lit("n/a"))


def all_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))
