"""Personal data, injection, secrets, budgets and the caller's patterns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regexes import searched
from ..functions.values import bound, get, is_number, is_object, is_string, kind, number, text
from .base import Guard, Response

# The default patterns, all searched without case.
PII_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}
INJECTION_PATTERNS = (
    r"ignore\s+(previous|all|above)\s+(instructions?|prompts?)",
    r"disregard\s+(previous|all|above)",
    r"forget\s+(everything|all|your\s+instructions)",
    r"you\s+are\s+now\s+",
    r"act\s+as\s+if\s+you\s+are",
    r"pretend\s+(you|to\s+be)",
    r"new\s+instructions?\s*:",
    r"system\s*:\s*",
    r"<\|.*?\|>",
    r"\[\[.*?\]\]",
)
HARMFUL_PATTERNS = (
    r"password\s*[=:]\s*\S+",
    r"api[_-]?key\s*[=:]\s*\S+",
    r"secret\s*[=:]\s*\S+",
    r"private[_-]?key",
    r"BEGIN\s+(RSA|DSA|EC)\s+PRIVATE\s+KEY",
)


def found_in(content: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that occur, in order.  One joint pattern is tried first."""
    if not patterns:
        return F.array().cast("array<string>")
    each = F.array_compact(F.array(*[F.when(searched(content, p, True), F.lit(n)) for n, p in patterns.items()]))
    joint = [p for n, p in patterns.items() if p != PII_PATTERNS["email"]]
    any_ = searched(content, "|".join(f"(?:{p})" for p in joint), True) if joint else F.lit(False)
    if len(joint) < len(patterns):  # an address has this sign, and without it the pattern tries every word from each of its letters
        any_ = (F.contains(content, F.lit("@")) & searched(content, PII_PATTERNS["email"], True)) | any_
    return F.when(any_, each).otherwise(F.array().cast("array<string>"))


class SafetyGuard(Guard):
    name = "SafetyGuard"

    def __init__(
        self,
        check_pii: bool = True,
        check_injection: bool = True,
        check_harmful: bool = True,
        check_budget: bool = True,
        pii_allow_list: Iterable[str] | None = None,
        max_cost: float | None = None,
        max_tokens: int | None = None,
        custom_patterns: Iterable[str] | None = None,
    ):
        allowed = set(pii_allow_list or ())
        self.pii = {n: p for n, p in PII_PATTERNS.items() if n not in allowed} if check_pii else {}
        self.injection = {p: p for p in INJECTION_PATTERNS} if check_injection else {}
        self.harmful = {p: p for p in HARMFUL_PATTERNS} if check_harmful else {}
        self.max_cost, self.max_tokens = (max_cost, max_tokens) if check_budget else (None, None)
        self.custom = list(custom_patterns or ())

    @staticmethod
    def content(r: Response) -> Column:
        """All texts that are looked at, joined by one space."""
        string = lambda k: F.when(is_string(get(r.value, k)), text(get(r.value, k)))
        written = lambda k: F.when(is_object(get(r.value, k)), F.get_json_object(r.raw, f"$.{k}"))
        return F.concat_ws(" ", string("content"), string("output"), string("text"), written("output"), written("arguments"))

    def budget(self, r: Response) -> tuple[Column, Column]:
        """(messages, whether the check crashes)."""
        usage, messages, bad = get(r.value, "usage"), [], F.lit(False)
        for most, before, now, unit, words in ((self.max_cost, "total_cost", "cost", "$", "Cost exceeds limit: "), (self.max_tokens, "total_tokens", "total_tokens", "", "Tokens exceed limit: ")):
            if not most:
                continue
            a, b = get(r.context, before), get(usage, now)
            value = lambda v: F.when(v.isNull(), F.lit(0.0)).otherwise(number(v))
            total = value(a) + value(b)
            bad = bad | (usage.isNotNull() & ~is_object(usage)) | (a.isNotNull() & ~is_number(a)) | (b.isNotNull() & ~is_number(b))
            whole = F.when((F.round(total) == total) & ~kind(a).startswith("D") & ~kind(b).startswith("D"), total.cast("long").cast("string")).otherwise(total.cast("string"))
            messages.append(F.when(total > most, F.concat(F.lit(f"{words}{unit}"), whole, F.lit(f" > {unit}{most}"))))
        return (F.array_compact(F.array(*messages)) if messages else F.array()).cast("array<string>"), bad

    def column(self, r: Response) -> Column:
        budget, bad = self.budget(r)

        def issues(content: Column) -> Column:
            groups = [("pii", "warning", found_in(content, self.pii)), ("injection", "error", found_in(content, self.injection)), ("harmful", "error", found_in(content, self.harmful)), ("budget", "error", budget)]
            groups += [("custom_pattern", "error", F.when(searched(content, p), F.array(F.lit(p))).otherwise(F.array().cast("array<string>"))) for p in self.custom]
            return F.filter(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), d.alias("details")) for t, s, d in groups]), lambda x: F.size(x["details"]) > 0)

        def verdict(found: Column) -> Column:
            count = lambda s: F.size(F.filter(found, lambda x: x["severity"] == s))
            details = F.struct(found.alias("issues"))
            return (
                F.when(count("error") > 0, self.fails(F.format_string("Safety check failed: %d critical issue(s)", count("error")), details))
                .when(count("warning") > 0, self.warns(F.format_string("Safety warnings: %d warning(s)", count("warning")), details))
                .otherwise(self.passes("All safety checks passed"))
            )

        return F.when(~is_object(r.value) | bad, self.crash("malformed usage or response")).otherwise(bound(bound(self.content(r), issues), verdict))


class JsSafetyGuard(Guard):
    """The JavaScript profile: four kinds of personal data with case, five injection patterns, which block at once."""

    name = "SafetyGuard"

    def column(self, r: Response) -> Column:
        names = {"email": "email", "phone": "phone", "ssn": "ssn", "creditCard": "credit_card"}

        def verdict(content: Column) -> Column:
            pii = F.array_compact(F.array(*[F.when(searched(content, PII_PATTERNS[p]), F.lit(n)) for n, p in names.items()]))
            injection = F.lit(False)
            for p in INJECTION_PATTERNS[:5]:
                injection = injection | searched(content, p, True)
            warned = lambda found: F.when(F.size(found) > 0, self.warns(F.concat(F.lit("Safety issues detected: "), F.array_join(found, ", ")), F.struct(found.alias("pii")))).otherwise(self.passes("All safety checks passed"))
            return F.when(injection, self.fails("BLOCKED: Prompt injection detected")).otherwise(bound(pii, warned))

        return bound(F.coalesce(SafetyGuard.content(r), F.lit("")), verdict)
