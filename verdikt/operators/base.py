"""What a guard is: an object that makes a result column from a response."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT = "struct<guard:string,passed:boolean,message:string,details:string,severity:string,crashed:boolean>"


@dataclass(frozen=True)
class Response:
    """Columns of a response: its JSON text, its value, and the caller's context (VARIANT, may be NULL)."""

    raw: Column
    value: Column
    context: Column


class Guard:
    """``column`` gives struct<guard, passed, message, details (JSON), severity, crashed>."""

    name = "Guard"

    def column(self, r: Response) -> Column:
        raise NotImplementedError

    def result(self, passed: bool, message: Column | str, details: Column | None = None, severity: str = "error", crashed: bool = False) -> Column:
        return F.struct(
            F.lit(self.name).alias("guard"),
            F.lit(passed).alias("passed"),
            (F.lit(message) if isinstance(message, str) else message).alias("message"),
            (F.lit(None).cast("string") if details is None else F.to_json(details)).alias("details"),
            F.lit(severity).alias("severity"),
            F.lit(crashed).alias("crashed"),
        )

    def passes(self, message: Column | str | None = None, details: Column | None = None) -> Column:
        return self.result(True, f"{self.name} passed" if message is None else message, details, "info")

    def fails(self, message: Column | str, details: Column | None = None, severity: str = "error") -> Column:
        return self.result(False, message, details, severity)

    def warns(self, message: Column | str, details: Column | None = None) -> Column:
        """Not passed, of severity warning."""
        return self.result(False, message, details, "warning")

    def crash(self, what: str = "unexpected value") -> Column:
        return self.result(False, f"Guard error: {what}", crashed=True)


class FunctionGuard(Guard):
    """A guard from a function of the response that gives a result column (see ``Guard.result``)."""

    def __init__(self, name: str, make: Callable[[FunctionGuard, Response], Column]):
        self.name, self.make = name, make

    def column(self, r: Response) -> Column:
        return self.make(self, r)


class PythonGuard(Guard):
    """A guard from a Python function (response dict, context dict) -> (passed, message, severity); Arrow batches.
    An exception is a crash, as in a built-in guard."""

    def __init__(self, name: str, check: Callable[[dict, dict], tuple[bool, str, str]]):
        self.name, self.check = name, check

    def column(self, r: Response) -> Column:
        name, check = self.name, self.check

        @F.pandas_udf(RESULT)
        def run(raw: pd.Series, context: pd.Series) -> pd.DataFrame:
            import json

            out = []
            for x, c in zip(raw, context):
                try:
                    passed, message, severity = check(json.loads(x), json.loads(c) if c else {})
                    out.append((name, passed, message, None, severity, False))
                except Exception as e:  # noqa: BLE001
                    out.append((name, False, f"Guard error: {e}", None, "error", True))
            return pd.DataFrame(out, columns=["guard", "passed", "message", "details", "severity", "crashed"])

        return run(r.raw, F.to_json(r.context))
