"""Shapes of other tools' records as responses (a JSON column ``raw``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.base import Guard
from ..operators.tool import ToolGuard
from ..plans.verify import ResponseVerifier, json_string, split, to_dict


def from_completions(rows: DataFrame, response: str = "response") -> DataFrame:
    """Provider responses (JSON objects) as they are; what is no object is refused: raises at run time."""
    v = F.try_parse_json(F.col(response))
    checked = F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), F.col(response)).otherwise(F.raise_error("a provider response must be an object"))
    return rows.withColumn("raw", checked)


def from_agent_actions(rows: DataFrame, tool: str = "tool", tool_input: str = "tool_input") -> DataFrame:
    """Agent actions; an input that is no JSON object is wrapped as {"input": ..}."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(tool_input))).startswith("OBJECT"), F.lit(False))
    arguments = F.when(is_object, F.col(tool_input)).otherwise(F.concat(F.lit('{"input":'), json_string(F.col(tool_input)), F.lit("}")))
    return rows.withColumn("raw", F.concat(F.lit('{"type":"tool_call","tool_name":'), json_string(F.col(tool)), F.lit(',"arguments":'), arguments, F.lit("}")))


def from_tool_starts(rows: DataFrame, name: str = "name", text: str = "input") -> DataFrame:
    return rows.withColumn("raw", F.concat(F.lit('{"type":"tool_call","tool_name":'), json_string(F.col(name)), F.lit(',"arguments":{"input":'), json_string(F.col(text)), F.lit("}}")))


def from_agent_finishes(rows: DataFrame, values: str = "return_values") -> DataFrame:
    return rows.withColumn("raw", F.concat(F.lit('{"type":"agent_output","output":'), F.coalesce(F.col(values), F.lit("null")), F.lit("}")))


def from_events(rows: DataFrame, event: str = "event", payload: str = "payload", retrievals: bool = True, syntheses: bool = True) -> DataFrame:
    """Framework events with a JSON payload: retrieved nodes (one row each), syntheses, function calls (always)."""
    p = F.col(payload)
    nodes = rows.where(F.lit(retrievals) & (F.col(event) == "retrieve")).withColumn("_node", F.explode(F.from_json(F.get_json_object(p, "$.nodes"), "array<struct<text:string,score:double>>")))
    parts = [nodes.withColumn("raw", F.concat(F.lit('{"type":"retrieval_node","content":'), json_string(F.col("_node.text")), F.lit(',"score":'), F.coalesce(F.col("_node.score").cast("string"), F.lit("null")), F.lit("}"))).drop("_node")]
    parts.append(rows.where(F.lit(syntheses) & (F.col(event) == "synthesize")).withColumn("raw", F.concat(F.lit('{"type":"synthesis_response","content":'), json_string(F.get_json_object(p, "$.response")), F.lit("}"))))
    call = F.concat(F.lit('{"type":"tool_call","tool_name":'), json_string(F.get_json_object(p, "$.name")), F.lit(',"arguments":'), F.coalesce(F.get_json_object(p, "$.arguments"), F.lit("{}")), F.lit("}"))
    parts.append(rows.where(F.col(event) == "function_call").withColumn("raw", call))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def guard_bodies(
    rows: DataFrame, verifier: ResponseVerifier, body: str = "body", path: str = "path", skip: Sequence[str] = (), request: bool = False, guards: Sequence[Guard] | None = None, block_on_failure: bool = True
) -> DataFrame:
    """HTTP bodies: ``status`` and ``out_body``, beside the verdict.  Whatever is not verified is stopped, warnings and crashed guards too, and its body tells each failed
    guard with its message.  Paths that begin with one of skip (responses only) and rows without a body go through.
    Without block_on_failure all bodies go through, with their verdicts beside them."""
    verdicts = verifier.verify(rows, guards, raw=body)
    through = F.col(body).isNull()
    for prefix in () if request else skip:
        through = through | F.coalesce(F.col(path).startswith(prefix), F.lit(False))
    told = F.transform(F.filter("guard_results", lambda g: ~g["passed"]), lambda g: F.struct(g["guard"].alias("guard"), g["message"].alias("message")))
    failed = F.to_json(F.struct(F.lit("REQUEST_BLOCKED" if request else "VERIFICATION_FAILED").alias("code"), F.col("block_reason").alias("reason"), told.alias("guards")))
    stop = ~through & ~F.col("verified") & F.lit(block_on_failure)
    return verdicts.withColumns({"status": F.when(stop & F.lit(request), 422).otherwise(200), "out_body": F.when(stop, failed).otherwise(F.col(body))})


def guard_tool_calls(rows: DataFrame, verifier: ResponseVerifier | None = None, body: str = "body", tool_guard: ToolGuard | None = None) -> DataFrame:
    """Request bodies with a tool guard (the default one, if none is given) before the verifier's own guards."""
    own = verifier.guards if verifier else []
    return guard_bodies(rows, verifier or ResponseVerifier(), body, request=True, guards=[tool_guard or ToolGuard(), *own])


def enforced(rows: DataFrame, verifier: ResponseVerifier, raw: str = "raw", context: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(released, refused): a response that is not verified is refused with ``payload`` and ``result`` (JSON); a released one carries its ``result``."""
    verdicts = to_dict(verifier.verify(rows, raw=raw, context=context)).withColumnRenamed("as_json", "result").drop("as_text")
    released, refused = split(verdicts)
    return released, refused.withColumn("payload", F.col(raw))
