"""Arithmetic: totals, percentages, calculations inside texts, and the caller's rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import bound, fields, get, is_number, is_object, is_string, number, shown, shown_number, text
from .base import Guard, Response

# Fixed values: (total, parts), a part with a minus sign is subtracted.
TOTALS = (
    ("total", ("subtotal", "tax", "shipping")),
    ("total", ("subtotal", "-discount", "tax")),
    ("net", ("gross", "-deductions")),
    ("balance", ("credits", "-debits")),
)
CALCULATION = r"(\d+(?:\.\d+)?)\s*([\+\-\*\/])\s*(\d+(?:\.\d+)?)\s*=\s*(\d+(?:\.\d+)?)"
EMPTY = "array<string>"


def compact(errors: list[Column]) -> Column:
    return F.array_compact(F.array(*errors)).cast(EMPTY) if errors else F.array().cast(EMPTY)


class MathGuard(Guard):
    name = "MathGuard"

    def __init__(self, tolerance: float = 0.01, verify_totals: bool = True, verify_percentages: bool = True, custom_rules: list[dict] | None = None, profile: str = "py"):
        """profile ``js``: one rule for totals, whose missing parts are 0."""
        self.tolerance, self.totals, self.percentages, self.rules, self.js = tolerance, verify_totals, verify_percentages, custom_rules or [], profile == "js"

    def off(self, a: Column, b: Column | float) -> Column:
        """Further apart than the tolerance; a NaN is not."""
        distance = F.abs(a - b)
        return (distance > self.tolerance) & ~F.isnan(distance)

    def fields(self) -> list[str]:
        """The fields that the rules for totals read."""
        if not self.totals:
            return []
        return ["total", "subtotal", "tax", "shipping", "discount"] if self.js else sorted({p.lstrip("-") for total, parts in TOTALS for p in (total, *parts)})

    def may_total(self, value: Column) -> Column:
        """Whether the fields that a rule cannot do without are there."""
        any_ = F.lit(False)
        for total in dict.fromkeys(["total"] if self.js else [total for total, _ in TOTALS]):
            any_ = any_ | value[total].isNotNull()
        return any_

    def total_errors(self, value: Column, n: Column) -> tuple[list[Column], Column]:
        """value: the fields' values; n: the same as doubles."""
        errors, bad, there = [], F.lit(False), lambda k: value[k].isNotNull()
        if self.js:
            part = lambda k: F.coalesce(n[k], F.lit(0.0))
            made = part("subtotal") + part("tax") + part("shipping") - part("discount")
            rule = there("total") & there("subtotal") & self.off(made, n["total"])
            return [F.when(rule, F.concat(F.lit("Total mismatch: expected "), shown_number(made), F.lit(", got "), shown(value["total"])))], bad
        for total, parts in TOTALS:
            made, all_there = F.lit(0.0), there(total)
            for p in parts:
                field = p.lstrip("-")
                all_there = all_there & there(field)
                bad = bad | (there(total) & there(field) & n[field].isNull())
                made = made - n[field] if p[0] == "-" else made + n[field]
            bad = bad | (all_there & ~is_number(value[total]))
            errors.append(F.when(all_there & self.off(made, n[total]), F.concat(F.lit(f"{total} mismatch: expected "), shown(value[total]), F.lit(", calculated "), shown_number(made))))
        return errors, bad

    def percentages_of(self, d: Column) -> Column:
        """base, amount and rate (doubles) of whatever keys there are."""
        pairs = lambda fields: F.transform(
            F.filter(F.map_keys(fields), lambda k: k.endswith("_percent") | k.endswith("_rate")),
            lambda k: F.struct(F.try_element_at(fields, base_key(k)).alias("base"), F.try_element_at(fields, F.concat(base_key(k), F.lit("_amount"))).alias("amount"), F.try_element_at(fields, k).alias("rate")),
        )
        base_key = lambda k: F.replace(F.replace(k, F.lit("_percent"), F.lit("")), F.lit("_rate"), F.lit(""))
        rows = F.filter(bound(F.try_variant_get(d, "$", "map<string,variant>"), pairs), lambda x: x["base"].isNotNull() & x["amount"].isNotNull())
        return F.transform(rows, lambda x: F.struct(number(x["base"]).alias("base"), number(x["amount"]).alias("amount"), (number(x["rate"]) / 100.0).alias("rate")))

    def percentage_errors(self, numbers: Column) -> tuple[Column, Column]:
        """(messages, whether one crashes)."""
        bad = F.exists(numbers, lambda x: x["base"].isNull() | x["amount"].isNull() | x["rate"].isNull())
        wrong = F.filter(numbers, lambda x: self.off(x["base"] * x["rate"], x["amount"]))
        message = lambda x: F.concat(F.lit("Percentage calculation error: "), shown_number(x["rate"] * 100), F.lit("% of "), shown_number(x["base"]), F.lit(" should be "), shown_number(x["base"] * x["rate"]), F.lit(", got "), shown_number(x["amount"]))
        return F.coalesce(F.transform(wrong, message), F.array().cast(EMPTY)), F.coalesce(bad, F.lit(False))

    def inline_errors(self, s: Column) -> Column:
        one = lambda m, k: F.regexp_extract(m, CALCULATION, k)
        parts = lambda m: F.struct(one(m, 1).cast("double").alias("a"), one(m, 2).alias("op"), one(m, 3).cast("double").alias("b"), one(m, 4).cast("double").alias("said"))
        value = lambda x: F.when(x["op"] == "+", x["a"] + x["b"]).when(x["op"] == "-", x["a"] - x["b"]).when(x["op"] == "*", x["a"] * x["b"]).when(x["b"] == 0, F.lit(float("inf"))).otherwise(x["a"] / F.nullif(x["b"], F.lit(0.0)))
        found = F.transform(F.regexp_extract_all(s, F.lit(CALCULATION), F.lit(0)), parts)
        wrong = F.filter(found, lambda x: self.off(value(x), x["said"]))
        return F.transform(wrong, lambda x: F.concat(F.lit("Calculation error: "), shown_number(x["a"]), F.lit(" "), x["op"], F.lit(" "), shown_number(x["b"]), F.lit(" = "), shown_number(x["said"]), F.lit(" (should be "), shown_number(value(x)), F.lit(")")))

    def rule_outcome(self, d: Column, is_object_: Column, is_string_: Column) -> Column:
        """struct<errors, bad> of the caller's rules; each reads its field once."""

        def judged(rule: dict, x: Column) -> Column:
            field, n, error = rule.get("field"), x["n"], F.lit(None).cast("string")
            if rule.get("type") == "equals":
                error = F.when(self.off(n, rule["expected"]), F.lit(f"{field} should equal {rule['expected']}"))
            elif rule.get("type") == "range":
                low, high = rule.get("min", float("-inf")), rule.get("max", float("inf"))
                error = F.when(((n < low) | (n > high)) & ~F.isnan(n), F.concat(F.lit(f"{field}="), shown_number(n), F.lit(f" outside range [{low}, {high}]")))
            bad = (is_object_ & x["there"] & n.isNull()) | (is_string_ & F.contains(text(d), F.lit(field)))
            return F.struct(error.alias("error"), bad.alias("bad"))

        def outcome(rule: dict) -> Column:
            read = bound(get(d, rule.get("field") or ""), lambda v: F.struct(v.isNotNull().alias("there"), number(v).alias("n")))
            return bound(read, lambda x: judged(rule, x))

        outcomes = [outcome(rule) for rule in self.rules]
        if not outcomes:
            return F.struct(F.array().cast(EMPTY).alias("errors"), F.lit(False).alias("bad"))
        return bound(F.array(*outcomes), lambda xs: F.struct(F.array_compact(F.transform(xs, lambda x: x["error"])).alias("errors"), F.exists(xs, lambda x: F.coalesce(x["bad"], F.lit(False))).alias("bad")))

    def column(self, r: Response) -> Column:
        none, no, names = F.array().cast(EMPTY), F.lit(False), self.fields()

        def checked(d: Column) -> Column:
            """struct<errors, bad> of a target."""
            outcome = lambda errors, bad: F.struct(errors.alias("errors"), bad.alias("bad"))

            def of_object() -> Column:
                parts = []
                if names:
                    totals = lambda v: bound(F.struct(*[number(v[k]).alias(k) for k in names]), lambda n: outcome(compact((x := self.total_errors(v, n))[0]), x[1]))
                    parts.append(bound(fields(d, *names), lambda v: F.when(self.may_total(v), totals(v)).otherwise(outcome(none, no))))
                if self.percentages:  # the key's text, or an escape that may hide it, must be there
                    may = F.contains(r.raw, F.lit("_percent")) | F.contains(r.raw, F.lit("_rate")) | F.contains(r.raw, F.lit("\\u"))
                    parts.append(F.when(may, bound(self.percentages_of(d), lambda n: outcome(*self.percentage_errors(n)))).otherwise(outcome(none, no)))
                if not parts:
                    return outcome(none, no)
                return bound(F.array(*parts), lambda all_: outcome(F.flatten(F.transform(all_, lambda x: x["errors"])), F.exists(all_, lambda x: x["bad"])))

            def of_kinds(k: Column) -> Column:
                own = F.when(k["is_object"], of_object()).when(k["is_string"], outcome(self.inline_errors(text(d)), no)).otherwise(outcome(none, no))
                if not self.rules:
                    return own
                return bound(F.struct(own.alias("own"), self.rule_outcome(d, k["is_object"], k["is_string"]).alias("rules")), lambda x: outcome(F.concat(x["own"]["errors"], x["rules"]["errors"]), x["own"]["bad"] | x["rules"]["bad"]))

            of_string = F.when(is_object(d), no).otherwise(is_string(d))  # the kind of an object lists all that it has
            return bound(F.struct(is_object(d).alias("is_object"), of_string.alias("is_string")), of_kinds)

        def verdict(x: Column) -> Column:
            failed = self.fails(F.format_string("Math verification failed: %d error(s)", F.size(x["errors"])), F.struct(x["errors"].alias("errors")))
            return F.when(x["bad"], self.crash("could not convert to float")).when(F.size(x["errors"]) > 0, failed).otherwise(self.passes("Math verification passed"))

        target = F.coalesce(get(r.value, "output"), r.value)
        return F.when(~is_object(r.value), self.crash("could not convert to float")).otherwise(bound(bound(target, checked), verdict))
