"""The rules of document arithmetic once more, in plain Python over one document at a time: what the library's columns are held against.

A document is JSON: currency, header amounts, document_date, due_date, line_items, tax_lines, evidence (path to {page,
quote}) and verified (names of fields that a person has confirmed). Each check is a linear form over amounts that must be
zero within a tolerance. An amount that isn't printed stands for the form that computes it, so a form solved for any
printed amount gives the value that would settle it.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import dataclass, field, replace
from decimal import ROUND_HALF_UP, Context, Decimal, Inexact, localcontext

from folio.functions.money import LIMIT
from folio.functions.printed import agreement, printed_amounts
from folio.schemas import DEFAULT_MINOR_UNIT, MINOR_UNITS

# Amounts of a header, places of other numbers, the highest plausible tax rate.
HEADER = ("subtotal", "discount", "shipping", "tax", "tip", "total", "amount_paid", "amount_due")
OTHER_PLACES = 6
TOP_RATE = Decimal("0.30")
NUMBER = re.compile(r"-?\d+(\.\d+)?", re.A)


@dataclass(frozen=True)
class Amount:
    value: Decimal | None = None
    unreadable: bool = False
    verified: bool = False
    quote: str | None = None
    page: int | None = None

    @property
    def present(self) -> bool:
        return self.unreadable or self.value is not None


@dataclass(frozen=True)
class Form:
    """Sum of coefficient times amount, plus a constant; also: amounts it was computed from without being linear in them."""

    coef: dict[str, Decimal] = field(default_factory=dict)
    const: Decimal = Decimal(0)
    also: tuple[str, ...] = ()

    def plus(self, other: Form, by: int | Decimal = 1) -> Form:
        coef = dict(self.coef)
        for path, c in other.coef.items():
            coef[path] = coef.get(path, Decimal(0)) + by * c
        return Form(coef, self.const + by * other.const, self.also + other.also)

    def paths(self) -> list[str]:
        return list(dict.fromkeys((*self.coef, *self.also)))


@dataclass
class Check:
    id: str
    status: str
    fields: list[str]
    delta: Decimal | None = None
    form: Form | None = None


@dataclass
class Papers:
    """A parsed document."""

    amounts: dict[str, Amount]
    lines: int | None
    taxes: int
    places: int
    dates: tuple[object, object]

    def form(self, path: str) -> Form:
        return Form({path: Decimal(1)})

    def value(self, form: Form, assumed: frozenset[str] = frozenset()) -> Decimal | None:
        total = form.const
        for path, c in form.coef.items():
            v = self.amounts[path].value
            if v is None and path in assumed:
                v = Decimal(0)
            if v is None:
                return None
            total += c * v
        return total

    def fits(self, v: Decimal) -> bool:
        return v == v.quantize(self.unit) if abs(v) < LIMIT else False

    @property
    def unit(self) -> Decimal:
        return Decimal(1).scaleb(-self.places)


def parse(doc: dict) -> tuple[Papers, list[Check]]:
    """The amounts of a document, and a failed format check for each unusable one."""
    code = doc.get("currency")
    places = MINOR_UNITS.get(code.strip().upper(), DEFAULT_MINOR_UNIT) if isinstance(code, str) else DEFAULT_MINOR_UNIT
    verified, evidence, failed = set(doc.get("verified") or ()), doc.get("evidence") or {}, []
    amounts: dict[str, Amount] = {}

    def read(path: str, raw: object, name: str, most: int) -> None:
        cite = evidence.get(path)
        cite = cite if isinstance(cite, dict) else {}
        quote = cite.get("quote") if isinstance(cite.get("quote"), str) else None
        text = raw.strip() if isinstance(raw, str) else format(raw, "f") if isinstance(raw, (int, Decimal)) and not isinstance(raw, bool) else None
        value = Decimal(text) if text and NUMBER.fullmatch(text) else None
        if value is not None and (abs(value) >= LIMIT or value != value.quantize(Decimal(1).scaleb(-most))):
            value = None
        bad = raw is not None and value is None
        if bad:
            failed.append(Check(f"format:{path}", "fail", [path]))
        amounts[path] = Amount(value, bad, name in verified, quote, cite.get("page"))

    for name in HEADER:
        read(name, doc.get(name), name, places)
    lines, taxes = doc.get("line_items"), doc.get("tax_lines") or []
    for i, row in enumerate(lines or []):
        row = row if isinstance(row, dict) else {}
        for cell, most in (("quantity", OTHER_PLACES), ("unit_price", OTHER_PLACES), ("total", places)):
            read(f"line_items[{i}].{cell}", row.get(cell), "line_items", most)
    for i, row in enumerate(taxes):
        row = row if isinstance(row, dict) else {}
        for cell, most in (("rate", OTHER_PLACES), ("base", places), ("amount", places)):
            read(f"tax_lines[{i}].{cell}", row.get(cell), "tax_lines", most)
    return Papers(amounts, None if lines is None else len(lines), len(taxes), places, (doc.get("document_date"), doc.get("due_date"))), failed


class Rules:
    """One run of every rule over a document."""

    def __init__(self, p: Papers, readings: bool = True, second_base: bool = True):
        self.p, self.a, self.readings, self.second_base = p, p.amounts, readings, second_base
        self.assumed: frozenset[str] = frozenset()
        self.included = False

    def equation(self, name: str, form: Form, tolerance: Decimal = Decimal(0)) -> Check:
        delta = self.p.value(form, self.assumed)
        status = "skipped" if delta is None else "pass" if abs(delta) <= tolerance else "fail"
        return Check(name, status, form.paths(), delta, form)

    def judged(self, name: str, fields: list[str], verdict: bool | None) -> Check:
        return Check(name, "skipped" if verdict is None else "pass" if verdict else "fail", fields)

    def rate(self, tax: Decimal, base: Decimal) -> Decimal:
        return Context(prec=60, rounding=ROUND_HALF_UP).divide(tax, base).quantize(Decimal("0.0001"), ROUND_HALF_UP)

    def run(self) -> list[Check]:
        p, a, one = self.p, self.a, self.p.form
        quotes = [self.judged(f"quote:{path}", [path], agreement(x.value, x.quote, p.places if re.search(r"^[a-z_]+$|total$|base$|amount$", path) else None) == "pass") for path, x in a.items() if x.value is not None and not x.verified and not agreement(x.value, x.quote).startswith("skipped")]
        present = [self.judged("lines_present", ["line_items", "subtotal"], (p.lines or 0) > 0)] if a["subtotal"].value is not None and p.lines is not None else []
        math, totals, rounded = self.lines()
        lines_sum = Form()
        for t in totals:
            lines_sum = lines_sum.plus(t)
        slack = p.unit / 2 * rounded
        known = bool(totals) and p.value(lines_sum) is not None
        if a["subtotal"].present or not known:
            subtotal = one("subtotal")
            sums = self.equation("lines_sum", lines_sum.plus(subtotal, -1), slack) if totals else Check("lines_sum", "skipped", ["subtotal"])
        else:
            subtotal, sums = lines_sum, Check("lines_sum", "skipped", lines_sum.paths())
        tax, tax_sums = self.tax()
        total = self.total(subtotal, tax)
        sums, total, net, discounted = self.read_otherwise(sums, total, subtotal, tax, lines_sum, slack)
        rates = self.tax_lines(subtotal, net, discounted)
        base = one("total").plus(tax, -1) if net else subtotal
        amounts = p.value(tax), p.value(base)
        bound = None if None in amounts or not amounts[1] else 0 <= self.rate(*amounts) <= TOP_RATE
        signs = []
        for name, form in (("subtotal", subtotal), ("tax", tax), *((n, one(n)) for n in ("total", "discount", "shipping", "tip", "amount_paid"))):
            if name in ("subtotal", "tax", "total") or a[name].present:
                v = p.value(form)
                signs.append(self.judged(f"non_negative:{name}", form.paths(), None if v is None else v >= 0))
        return [*quotes, *present, *math, sums, *tax_sums, *rates, total, self.judged("tax_rate", tax.plus(base).paths(), bound), *self.balance(), *self.due(), *signs]

    def lines(self) -> tuple[list[Check], list[Form], int]:
        checks, totals, rounded = [], [], 0
        for i in range(self.p.lines or 0):
            q, u, t = (f"line_items[{i}].{c}" for c in ("quantity", "unit_price", "total"))
            product = None if self.a[q].value is None or self.a[u].value is None else self.a[q].value * self.a[u].value
            odd = product is not None and not self.p.fits(product)
            rounded += odd
            if product is None or not self.a[t].present:
                checks.append(Check(f"line_math[{i}]", "skipped", [q, u, t]))
            else:
                checks.append(self.equation(f"line_math[{i}]", Form({t: Decimal(-1)}, product, (q, u)), self.p.unit if odd else Decimal(0)))
            computed = product is not None and not self.a[t].present
            totals.append(Form({}, product.quantize(self.p.unit, ROUND_HALF_UP), (q, u)) if computed else self.p.form(t))
        return checks, totals, rounded

    def tax(self) -> tuple[Form, list[Check]]:
        """The tax, or the sum of its lines where it isn't printed."""
        tax, sums = self.p.form("tax"), Form()
        if not self.p.taxes:
            return tax, []
        for i in range(self.p.taxes):
            sums = sums.plus(self.p.form(f"tax_lines[{i}].amount"))
        if not self.a["tax"].present and self.p.value(sums) is not None:
            return sums, [Check("tax_lines_sum", "skipped", sums.paths())]
        return tax, [self.equation("tax_lines_sum", sums.plus(tax, -1))]

    def total_form(self, subtotal: Form, tax: Form | None, discount: bool = True) -> Form:
        form = subtotal
        for name, sign in (("discount", -1), ("shipping", 1), ("tip", 1)):
            if self.a[name].present and (discount or name != "discount"):
                form = form.plus(self.p.form(name), sign)
        if tax is not None:
            form = form.plus(tax)
        return form.plus(self.p.form("total"), -1)

    def total(self, subtotal: Form, tax: Form) -> Check:
        """A tax that isn't printed counts as nothing, if all else is known."""
        if not self.a["tax"].present and "tax" in tax.coef and self.p.value(self.total_form(subtotal, None)) is not None:
            self.assumed |= {"tax"}
        return self.equation("total_math", self.total_form(subtotal, tax))

    def read_otherwise(self, sums: Check, total: Check, subtotal: Form, tax: Form, lines_sum: Form, slack: Decimal) -> tuple[Check, Check, bool, bool]:
        """Subtotals after the discount, subtotals that hold the tax, lines that hold the tax: tried after a failure only."""
        value, a = self.p.value, self.a
        net = discounted = False
        if not self.readings:
            return sums, total, net, discounted
        t, all_in = value(tax), a["total"].value
        if sums.status == "fail" and (a["discount"].value or 0) > 0:
            less = self.equation("lines_sum", sums.form.plus(self.p.form("discount"), -1), slack)
            after = self.equation("total_math", self.total_form(subtotal, tax, discount=False))
            if less.status == after.status == "pass":
                self.included = True
                return less, after, net, True
        if total.status == "fail":
            gross = self.equation("total_math", self.total_form(subtotal, None))
            if t is not None and t > 0 and all_in - t > 0 and self.rate(t, all_in - t) <= TOP_RATE and gross.status == "pass":
                self.included = net = True
                total = replace(gross, fields=[*gross.fields, *tax.paths()])
        elif sums.status == "fail" and total.status == "pass":
            s = a["subtotal"].value
            gross = self.equation("lines_sum", self.total_form(lines_sum, None), slack)
            if t is not None and t > 0 and s is not None and s > 0 and self.rate(t, s) <= TOP_RATE and gross.status == "pass":
                self.included = True
                sums = replace(gross, fields=[*gross.fields, *tax.paths()])
        return sums, total, net, discounted

    def tax_lines(self, subtotal: Form, net: bool, discounted: bool) -> list[Check]:
        checks, one = [], self.p.form
        for i in range(self.p.taxes):
            rate, base, amount = (f"tax_lines[{i}].{c}" for c in ("rate", "base", "amount"))
            bases = [one(base)]
            if not self.a[base].present:
                first = subtotal.plus(one("tax"), -1) if net else subtotal
                if self.a["discount"].present and not discounted:
                    first = first.plus(one("discount"), -1)
                bases = [first, first.plus(one("shipping"))] if self.a["shipping"].present and self.second_base else [first]
            tried = [self.tax_line(i, rate, b, amount) for b in bases]
            checks.append(next((c for c in tried if c.status == "pass"), tried[0]))
        return checks

    def tax_line(self, i: int, rate: str, base: Form, amount: str) -> Check:
        r, b, name = self.a[rate].value, self.p.value(base), f"tax_line_math[{i}]"
        if r is None or b is None or self.a[amount].value is None:
            return Check(name, "skipped", [rate, *base.paths(), amount])
        product = r.scaleb(-2) * b
        # a base made of several amounts isn't solved for any of them
        left = Form({k: c * r.scaleb(-2) for k, c in base.coef.items()}) if len(base.coef) == 1 and not base.const else Form({}, product, tuple(base.paths()))
        return self.equation(name, replace(left.plus(self.p.form(amount), -1), also=(*left.also, rate)), Decimal(0) if self.p.fits(product) else self.p.unit)

    def balance(self) -> list[Check]:
        paid, due = self.a["amount_paid"], self.a["amount_due"]
        if not paid.present and not due.present:
            return []
        form = self.p.form("total").plus(self.p.form("amount_paid"), -1).plus(self.p.form("amount_due"), -1)
        if not paid.present and due.value is not None and self.a["total"].value is not None:
            self.assumed |= {"amount_paid"}
        return [self.equation("balance_math", form)]

    def due(self) -> list[Check]:
        if self.p.dates[1] is None:
            return []
        days = []
        for text in self.p.dates:
            try:
                days.append(dt.date.fromisoformat(text) if re.fullmatch(r"\d{4}-\d\d-\d\d", text) else None)
            except (TypeError, ValueError):
                days.append(None)
        return [self.judged("due_date_order", ["document_date", "due_date"], None if None in days else days[0] <= days[1])]


def folded(checks: list[Check]) -> str:
    found = {c.status for c in checks}
    return next((s for s in ("fail", "pass") if s in found), "skipped")


def can_change(p: Papers, path: str) -> bool:
    return not p.amounts[path].verified and (path in HEADER or path.endswith((".total", ".amount")))


def changed(p: Papers, values: dict[str, Decimal]) -> Papers:
    """p with some amounts set; a quote that contradicts its new value goes."""
    amounts = dict(p.amounts)
    for path, v in values.items():
        x = amounts[path]
        amounts[path] = replace(x, value=v, quote=x.quote if agreement(v, x.quote, p.places) == "pass" else None)
    return replace(p, amounts=amounts)


def one_reading(p: Papers, checks: list[Check]) -> bool:
    """Whether the tax and the amount of the only tax line are one printed number: they agree and cite a common number of one
    page, or lack citations while the line has no base."""
    if p.taxes != 1 or not any(c.id == "tax_lines_sum" and c.status == "pass" for c in checks):
        return False
    pair = [p.amounts["tax"], p.amounts["tax_lines[0].amount"]]
    if any(x.verified for x in pair):
        return False
    shown = [set(printed_amounts(x.quote, p.places)) if x.page is not None else set() for x in pair]
    if all(shown):
        return pair[0].page == pair[1].page and bool(shown[0] & shown[1])
    return not p.amounts["tax_lines[0].base"].present


def suggest(p: Papers, checks: list[Check], rules: Rules, failed_format: bool) -> tuple[str, Decimal] | None:
    """The single change of one amount that makes every failed check pass and none fail, if there is exactly one."""
    if failed_format:
        return None
    failing, paired = [c for c in checks if c.status == "fail"], one_reading(p, checks)
    found: dict[tuple[str, Decimal], bool] = {}

    def propose(path: str, value: Decimal, quoted: bool) -> None:
        path = "tax" if paired and path == "tax_lines[0].amount" else path
        keeps_sign = path == "amount_due" or path.startswith("line_items")
        if p.fits(value) and value != p.amounts[path].value and (value >= 0 or keeps_sign):
            found[path, value] = found.get((path, value), True) and quoted

    for c in failing:
        if c.id.startswith("quote:") and can_change(p, c.fields[0]):
            x = p.amounts[c.fields[0]]
            shown = printed_amounts(x.quote, p.places)
            if len(shown) == 1:
                propose(c.fields[0], shown[0].copy_sign(x.value), True)
        for path, coef in (c.form.coef if c.form else {}).items():
            if coef and can_change(p, path):
                try:
                    with localcontext() as exact:
                        exact.traps[Inexact] = True
                        step = c.delta / coef
                except Inexact:
                    continue
                propose(path, (p.amounts[path].value or Decimal(0)) - step, False)

    def settles(path: str, value: Decimal, quoted: bool) -> bool:
        values = {path: value} | ({"tax_lines[0].amount": value} if paired and path == "tax" else {})
        after = Rules(changed(p, values), rules.included, False).run()
        passing = {c.id for c in after if c.status == "pass"}
        judged = not quoted or any(c.form and c.status != "skipped" and path in c.fields for c in after)
        return judged and folded(after) != "fail" and all(c.id in passing for c in failing)

    left = [key for key, quoted in found.items() if settles(*key, quoted)]
    return left[0] if len(left) == 1 and left[0][0] not in rules.assumed else None


def reconcile(doc: dict) -> dict:
    """The report of a document as plain values. Amounts are strings padded to the currency's minor unit."""
    with localcontext() as exact:
        exact.prec = 400
        p, formats = parse(doc)
        rules = Rules(p)
        checks = formats + rules.run()
        fix = suggest(p, checks, rules, bool(formats)) if folded(checks) == "fail" else None
        show = lambda v: None if v is None else format(v.quantize(p.unit) if p.fits(v) else v.normalize(), "f")
        return {
            "status": folded(checks),
            "checks": [{"id": c.id, "status": c.status, "delta": show(c.delta), "fields": c.fields} for c in checks],
            "suggestion": fix and {"path": fix[0], "current": show(p.amounts[fix[0]].value), "value": show(fix[1])},
            "error": None,
        }


def report(text: str | None) -> dict:
    """One bad document gives an error."""
    try:
        doc = json.loads(text, parse_float=Decimal, parse_int=Decimal)
        return reconcile(doc)
    except Exception as e:
        return {"status": None, "checks": [], "suggestion": None, "error": f"{type(e).__name__}: {e}"}
