"""Rules for the arguments of a call."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regexes import matched
from ..functions.values import bound, get, is_array, is_boolean, is_integer, is_number, is_object, is_string, items, known, number, plain, shown, text, truthy, type_name
from .base import Guard, Response

# Formats.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r'^https?://[^\s<>"{}|\\^`\[\]]+$'
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def equal(v: Column, x) -> Column:
    """Equality of a value and a Python one; numbers and booleans compare by value."""
    if isinstance(x, str):
        return is_string(v) & (text(v) == x)
    if isinstance(x, (bool, int, float)):
        return is_number(v) & (number(v) == float(x))
    return F.to_json(plain(v)) == json.dumps(x, separators=(",", ":"), sort_keys=True)


class ArgumentGuard(Guard):
    name = "ArgumentGuard"

    def __init__(self, rules: dict[str, dict] | None = None, strict: bool = True, allow_extra_args: bool = True):
        """strict is kept and has no effect."""
        self.rules, self.strict, self.allow_extra = rules or {}, strict, allow_extra_args

    def errors_of(self, name: str, rule: dict, v: Column) -> list[Column]:
        expected = lambda what: F.concat(F.lit(f"{name}: expected {what}, got "), type_name(v))
        kind, out = rule.get("type", "any"), []
        formats = {"email": (EMAIL, False, "invalid email format"), "url": (URL, False, "invalid URL format"), "uuid": (UUID, True, "invalid UUID format"), "pattern": (rule.get("pattern", ".*"), False, "does not match pattern")}
        tests = {"string": is_string, "number": is_number, "boolean": is_boolean}
        if kind in tests:
            out.append(F.when(~tests[kind](v), expected(kind)))
        if kind == "integer":
            out.append(F.when(~(is_integer(v) | is_boolean(v)), expected(kind)))
        if kind == "number":
            for limit, wrong, sign in (("min", number(v) < rule.get("min", 0), "<"), ("max", number(v) > rule.get("max", 0), ">")):
                if limit in rule:
                    out.append(F.when(is_number(v) & wrong, F.concat(F.lit(f"{name}: "), shown(v), F.lit(f" {sign} {limit} ({rule[limit]})"))))
        if kind in formats:
            pattern, ignore_case, message = formats[kind]
            out.append(F.when(~(is_string(v) & matched(text(v), pattern, ignore_case)), F.lit(f"{name}: {message}")))
        if kind == "enum":
            allowed, ok = rule.get("values", []), F.lit(False)
            for x in allowed:
                ok = ok | F.coalesce(equal(v, x), F.lit(False))
            out.append(F.when(~ok, F.concat(F.lit(f"{name}: '"), shown(v), F.lit(f"' not in {allowed}"))))
        size = F.when(is_string(v), F.length(text(v))).when(is_array(v), F.size(items(v)))
        for limit, wrong, sign, word in (("min_length", size < rule.get("min_length", 0), "<", "min"), ("max_length", size > rule.get("max_length", 0), ">", "max")):
            if limit in rule:
                out.append(F.when(wrong, F.concat(F.lit(f"{name}: length "), size.cast("string"), F.lit(f" {sign} {word} ({rule[limit]})"))))
        return out

    def column(self, r: Response) -> Column:
        # Arguments, each argument's kind and the errors are made once: as plain expressions they repeat one another in every branch.
        own, output = get(r.value, "arguments"), get(r.value, "output")
        arguments = known(own, lambda v: F.when(truthy(v), v.value).otherwise(F.coalesce(output, v.value, F.parse_json(F.lit("{}")))))
        return F.when(~is_object(r.value), self.crash("not an object")).otherwise(bound(arguments, self.of_arguments))

    def of_arguments(self, arguments: Column) -> Column:
        return F.when(~is_object(arguments), self.passes("No arguments to validate")).otherwise(bound(self.found(arguments), self.verdict))

    def found(self, arguments: Column) -> Column:
        none, errors = F.array().cast("array<string>"), []
        for name, rule in self.rules.items():
            missing = F.array(F.lit(f"Missing required argument: {name}")) if rule.get("required") else none
            of = lambda v, name=name, rule=rule, missing=missing: F.when(v.value.isNull(), missing).otherwise(F.array(*self.errors_of(name, rule, v)).cast("array<string>"))
            errors.append(known(get(arguments, name), of))
        if not self.allow_extra:
            unknown = F.array_sort(F.array_except(F.map_keys(F.try_variant_get(arguments, "$", "map<string,variant>")), F.array(*map(F.lit, self.rules)).cast("array<string>")))
            errors.append(bound(unknown, lambda extra: F.array(F.when(F.size(extra) > 0, F.concat(F.lit("Unexpected arguments: "), F.array_join(extra, ", "))))))
        return F.array_compact(F.flatten(F.array(*errors))) if errors else none

    def verdict(self, found: Column) -> Column:
        failed = self.fails(F.format_string("Argument validation failed: %d error(s)", F.size(found)), F.struct(found.alias("errors")))
        return F.when(F.size(found) > 0, failed).otherwise(self.passes("All arguments valid"))
