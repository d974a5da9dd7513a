"""Tool calls: count, block list, allow list, patterns in arguments, validators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regexes import searched
from ..functions.values import bound, get, has, is_array, is_object, items, kind
from .base import Guard, Response

# Tools blocked by default, and dangerous patterns in arguments.
BLOCKED_TOOLS = ("execute_shell", "shell", "bash", "cmd", "exec", "eval", "delete_file", "remove_file", "write_file", "modify_file", "send_email", "transfer_money", "make_payment")
DANGEROUS_PATTERNS = (
    r"(?i)DROP\s+TABLE",
    r"(?i)DELETE\s+FROM",
    r"(?i)TRUNCATE\s+TABLE",
    r"rm\s+-rf",
    r"rmdir\s+/s",
    r"del\s+/f",
    r"format\s+c:",
    r"sudo\s+",
    r"chmod\s+777",
    r"eval\s*\(",
    r"exec\s*\(",
    r"__import__",
    r"subprocess",
    r"os\.system",
)
#: The JavaScript profile's patterns, all without case.
JS_PATTERNS = (r"DROP\s+TABLE", r"DELETE\s+FROM", r"TRUNCATE\s+TABLE", r"rm\s+-rf", r"sudo\s+", r"eval\s*\(", r"exec\s*\(", r"__import__")

CALL = "struct<tool_name:string,name:string,toolName:string,arguments:string>"
SHAPE = f"struct<type:string,tool_name:string,name:string,toolName:string,arguments:string,tool_calls:array<{CALL}>,toolCalls:array<{CALL}>,choices:array<struct<message:struct<tool_calls:array<{CALL}>>>>>"


class PythonValidator:
    """A Python validator of a tool: arguments (as read from JSON) to (valid, message).  It runs in Arrow batches; its exception is a failure that blocks."""

    def __init__(self, check: Callable[[object], tuple[bool, str]]):
        self.check = check


def python_failures(validators: dict[str, PythonValidator], calls: Column) -> Column:
    """For each call (struct of tool and arguments) what its validator has against it, or NULL."""
    checks = {name: v.check for name, v in validators.items()}

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        import json

        def said(call: dict) -> str | None:
            tool = call.get("tool")
            if tool not in checks:
                return None
            try:
                valid, message = checks[tool](json.loads(call["arguments"]))
            except Exception as e:  # noqa: BLE001
                return f"Tool validator error: {e}"
            return None if valid else f"Tool '{tool}' validation failed: {message}"

        return pd.Series([[said(c) for c in json.loads(x)] if x else [] for x in batch])

    return run(F.to_json(calls, {"ignoreNullFields": "false"}))


class ToolGuard(Guard):
    name = "ToolGuard"

    def __init__(
        self,
        blocked_tools: Iterable[str] | None = None,
        allowed_tools: Iterable[str] | None = None,
        use_default_blocklist: bool = True,
        dangerous_patterns: Iterable[str] | None = None,
        use_default_patterns: bool = True,
        custom_validators: dict[str, Callable[[Column], tuple[Column, Column]] | PythonValidator] | None = None,
        max_calls_per_response: int = 10,
        profile: str = "py",
    ):
        """custom_validators: by tool, a function from the arguments column (JSON text) to (valid, message) columns, which must not raise
        (``try_`` forms; NULL is not valid), or a ``PythonValidator``, whose exceptions are failures.
        profile: ``py`` or ``js`` (no cap, no provider choices, an empty allow list blocks all)."""
        self.js = profile == "js"
        self.blocked = sorted(set(blocked_tools or ()) | (set(BLOCKED_TOOLS) if use_default_blocklist else set()))
        self.allowed = None if allowed_tools is None else sorted(set(allowed_tools))
        defaults = JS_PATTERNS if self.js else DANGEROUS_PATTERNS
        self.patterns = [*(defaults if use_default_patterns or self.js else ()), *(dangerous_patterns or ())]
        self.validators, self.max_calls = custom_validators or {}, max_calls_per_response

    def calls(self, r: Response) -> Column:
        """array<struct<tool, shown, arguments>>: the response itself, its calls, its choices' calls."""
        shape = F.from_json(r.raw, SHAPE)
        none = F.array().cast(f"array<{CALL}>")
        own = F.when(shape["type"] == "tool_call", F.array(F.struct(*[shape[f] for f in ("tool_name", "name", "toolName", "arguments")]))).otherwise(none)
        listed = F.coalesce(shape["toolCalls"], shape["tool_calls"], none) if self.js else F.coalesce(shape["tool_calls"], none)
        chosen = none if self.js else F.coalesce(F.flatten(F.transform(shape["choices"], lambda c: F.coalesce(c["message"]["tool_calls"], none))), none)
        full = lambda x: F.when(x != "", x)
        tool = lambda c: F.coalesce(full(c["toolName"]), full(c["tool_name"]), full(c["name"]), F.lit("unknown")) if self.js else F.coalesce(full(c["tool_name"]), full(c["name"]))
        return F.transform(F.concat(own, listed, chosen), lambda c: F.struct(tool(c).alias("tool"), c["tool_name"].alias("shown"), F.coalesce(c["arguments"], F.lit("{}")).alias("arguments")))

    def crashes(self, r: Response) -> Column:
        odd = lambda v: F.coalesce(F.exists(items(v), lambda x: ~is_object(x)), F.lit(False))
        calls, choices = get(r.value, "tool_calls"), get(r.value, "choices")
        message = F.coalesce(F.exists(items(choices), lambda c: kind(get(c, "message")) == "VOID"), F.lit(False))
        return ~is_object(r.value) | (has(r.value, "tool_calls") & (~is_array(calls) | odd(calls))) | (has(r.value, "choices") & (odd(choices) | message))

    def first_failure(self, call: Column) -> Column:
        """The call's first failure as struct<message, details>, or NULL."""
        tool = F.coalesce(call["tool"], F.lit("None"))
        found = lambda message, **details: F.struct(message.alias("message"), F.to_json(F.struct(*[v.alias(k) for k, v in details.items()])).alias("details"))
        rule = F.when(call["tool"].isin(self.blocked) if self.blocked else F.lit(False), found(F.format_string("BLOCKED: Tool '%s' is not allowed", tool), blocked_tool=call["tool"]))
        if self.allowed or (self.js and self.allowed is not None):
            outside = ~F.coalesce(call["tool"].isin(self.allowed), F.lit(False)) if self.allowed else F.lit(True)
            rule = rule.when(outside, found(F.format_string("BLOCKED: Tool '%s' is not in allowed list", tool), tool=call["tool"], allowed=F.array(*map(F.lit, self.allowed)).cast("array<string>")))
        for p in self.patterns:
            rule = rule.when(searched(call["arguments"], p, self.js), found(F.lit("BLOCKED: Dangerous pattern detected in tool arguments"), tool=call["tool"], pattern=F.lit(p)))
        for name, validate in self.validators.items():
            if isinstance(validate, PythonValidator):
                rule = rule.when((call["tool"] == name) & call["said"].isNotNull(), found(call["said"], tool=call["tool"]))
                continue
            valid, message = validate(call["arguments"])
            rule = rule.when((call["tool"] == name) & ~F.coalesce(valid, F.lit(False)), found(F.concat(F.lit(f"Tool '{name}' validation failed: "), message), tool=call["tool"]))
        return rule

    def column(self, r: Response) -> Column:
        calls = self.calls(r)
        if python := {k: v for k, v in self.validators.items() if isinstance(v, PythonValidator)}:
            calls = F.zip_with(calls, python_failures(python, calls), lambda c, said: c.withField("said", said))
        return F.when(self.crashes(r), self.crash("malformed tool calls")).otherwise(bound(calls, self.verdict))

    def verdict(self, calls: Column) -> Column:
        n = F.size(calls)
        out = F.when(n == 0, self.passes("No tool calls to verify"))
        if not self.js:
            out = out.when(n > self.max_calls, self.fails(F.format_string(f"Too many tool calls: %d (max: {self.max_calls})", n)))
        first = F.get(F.filter(F.transform(calls, self.first_failure), lambda x: x.isNotNull()), F.lit(0))
        return out.otherwise(bound(first, lambda failure: self.told(failure, calls)))

    def told(self, failure: Column, calls: Column) -> Column:
        n = F.size(calls)
        failed = F.struct(F.lit(self.name).alias("guard"), F.lit(False).alias("passed"), failure["message"].alias("message"), failure["details"].alias("details"), F.lit("error").alias("severity"), F.lit(False).alias("crashed"))
        return F.when(failure.isNotNull(), failed).otherwise(self.passes(F.format_string("All %d tool call(s) verified", n), F.struct(F.transform(calls, lambda c: c["shown"]).alias("tools_checked"))))
