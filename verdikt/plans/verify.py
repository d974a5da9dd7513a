"""Responses in, verdicts out: parse once, one struct for each guard, one fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import bound
from ..operators.base import Guard, Response
from ..operators.schema import SchemaGuard

SEVERITIES = ("error", "warning", "info")


#: Repeated keys of a JSON object: the last one counts.
LAST_KEY_COUNTS = "spark.sql.variant.allowDuplicateKeys"
#: A JSON string, or a number that JSON does not have but its readers take.
STRING_OR_NAN = r'(?s)("(?:[^"\\]|\\.)*+")|-?(?:NaN|Infinity)'


def fresh(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have (names are the same without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parsed(responses: DataFrame, raw: str = "raw", context: str | None = None) -> tuple[DataFrame, Response]:
    """The rows with columns for the response (its text, value and context), under names that clash with none.

    Text that is not one JSON value is a response of type text.  NaN and infinities are read (as strings of those names), and of
    repeated keys the last one counts; the text of an object that repeats a key is written anew.
    """
    responses.sparkSession.conf.set(LAST_KEY_COUNTS, "true")
    names = {c: fresh(f"_{c}", responses) for c in ("text", "list", "read", "raw", "value", "context")}
    col = lambda c: F.col(names[c])
    marked = F.regexp_replace(raw, STRING_OR_NAN, "$1\u0001")
    numbers = F.replace(F.replace(marked, F.lit('"\u0001'), F.lit('"')), F.lit("\u0001"), F.lit('"NaN"'))
    # Inside brackets, so that what stands behind a first value is not overlooked.
    as_list = lambda x: F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
    odd = (F.contains(raw, F.lit("NaN")) | F.contains(raw, F.lit("Infinity"))) & as_list(F.col(raw)).isNull()
    out = responses.withColumn(names["text"], F.when(odd, numbers).otherwise(F.col(raw)))
    out = out.withColumn(names["list"], F.try_variant_get(as_list(col("text")), "$", "array<variant>"))
    out = out.withColumn(names["read"], F.when(F.size(col("list")) == 1, F.get(col("list"), F.lit(0))))
    repeated = F.coalesce(bound(F.json_object_keys(col("text")), lambda keys: F.size(keys) > F.size(F.array_distinct(keys))), F.lit(False))
    as_text = F.to_json(F.struct(F.lit("text").alias("type"), F.col(raw).alias("content")))
    parsed_raw = F.when(F.col(raw).isNull(), F.lit(None).cast("string")).when(col("read").isNull(), as_text).when(repeated, F.to_json(col("read"))).otherwise(col("text"))
    given = F.lit(None).cast("string") if context is None else F.col(context)
    # The value does not read the new text, which is not made at all if no guard looks at it.
    value = F.coalesce(col("read"), F.when(F.col(raw).isNotNull(), F.try_parse_json(as_text)))
    out = out.withColumns({names["raw"]: parsed_raw, names["value"]: value, names["context"]: F.try_parse_json(given)}).drop(names["text"], names["list"], names["read"])
    return out, Response(col("raw"), col("value"), col("context"))


class ResponseVerifier:
    """Runs every guard, in order, and folds the results."""

    def __init__(self, default_guards: Sequence[Guard] | None = None, strict_mode: bool = True, allow_warnings: bool = True):
        self.guards, self.strict, self.allow_warnings = list(default_guards or ()), strict_mode, allow_warnings

    def verify(self, responses: DataFrame, guards: Sequence[Guard] | None = None, raw: str = "raw", context: str | None = None) -> DataFrame:
        """The rows with ``verified, guards_passed, guards_failed, guard_results, blocked, block_reason, timestamp``.

        guards override the default ones; an empty list means none.  raw: a JSON or text column; context: a JSON column.
        A NULL response is one that no guard can read: each guard fails with an error.
        """
        chosen = self.guards if guards is None else list(guards)
        rows, r = parsed(responses, raw, context)
        results = F.array(*[g.column(r) for g in chosen]) if chosen else F.array().cast("array<struct<guard:string,passed:boolean,message:string,details:string,severity:string,crashed:boolean>>")
        own = fresh("_results", rows)
        return rows.withColumn(own, results).select(*[F.col(c) for c in responses.columns], *self.folded(F.col(own)))

    def blocking(self, x: Column) -> Column:
        if not self.strict:
            return F.lit(False)
        bad = x["severity"] == "error" if self.allow_warnings else x["severity"].isin("error", "warning")
        return ~x["passed"] & bad & ~x["crashed"]

    def folded(self, results: Column) -> list[Column]:
        failed = F.size(F.filter(results, lambda x: ~x["passed"]))
        blocks = F.filter(results, self.blocking)
        shown = F.transform(results, lambda x: F.struct(*[x[f].alias(f) for f in ("guard", "passed", "message", "details", "severity")]))
        return [
            (failed == 0).alias("verified"),
            (F.size(results) - failed).alias("guards_passed"),
            failed.alias("guards_failed"),
            shown.alias("guard_results"),
            (F.size(blocks) > 0).alias("blocked"),
            F.get(blocks, F.size(blocks) - 1)["message"].alias("block_reason"),
            F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        ]

    def verify_tool_call(self, calls: DataFrame, tool_name: str, arguments: str, guards: Sequence[Guard] | None = None) -> DataFrame:
        """tool_name and arguments (JSON) columns as responses of type tool_call."""
        raw = tool_call(F.col(tool_name), F.col(arguments))
        own = fresh("_call", calls)
        return self.verify(calls.withColumn(own, raw), guards, own).drop(own)

    def verify_structured_output(self, outputs: DataFrame, output: str, schema: dict | None = None, guards: Sequence[Guard] | None = None) -> DataFrame:
        """An output column (JSON); a schema that is not empty is checked first.  Default guards are not used."""
        chosen = [*([SchemaGuard(schema)] if schema else []), *(guards or ())]
        raw = F.concat(F.lit('{"type":"structured_output","output":'), F.coalesce(F.col(output), F.lit("null")), F.lit("}"))
        own = fresh("_output", outputs)
        return self.verify(outputs.withColumn(own, raw), chosen, own).drop(own)


def tool_call(tool_name: Column, arguments: Column) -> Column:
    """JSON text of a tool call; arguments is JSON text."""
    return F.concat(F.lit('{"type":"tool_call","tool_name":'), json_string(tool_name), F.lit(',"arguments":'), F.coalesce(arguments, F.lit("null")), F.lit("}"))


def json_string(text: Column) -> Column:
    """A JSON string of a text, null for NULL."""
    inside = F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return F.when(text.isNull(), F.lit("null")).otherwise(inside)


def to_dict(verdicts: DataFrame) -> DataFrame:
    """Adds ``as_json``, the verdict without the response, and ``as_text``."""
    fields = ["verified", "guards_passed", "guards_failed", "guard_results", "blocked", "block_reason", "timestamp"]
    words = F.when(F.col("verified"), F.format_string("[OK] Verified (%d guards passed)", "guards_passed")).otherwise(F.format_string("[FAIL] Not verified (%d guards failed)", "guards_failed"))
    return verdicts.withColumns({"as_json": F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), "as_text": words})


def split(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(released, quarantined): what is not verified is set aside, warnings too."""
    return verdicts.where("verified"), verdicts.where("not verified")


def summary(verdicts: DataFrame, *by: str) -> DataFrame:
    """total, passed, failed, success_rate (1.0 when empty)."""
    total = F.count("*")
    passed = F.count_if("verified")
    rate = F.when(total == 0, F.lit(1.0)).otherwise(passed / F.nullif(total, F.lit(0)))
    return verdicts.groupBy(*by).agg(total.alias("total"), passed.alias("passed"), (total - passed).alias("failed"), rate.alias("success_rate"))
