"""Streams of items: tool calls are verified, blocked ones replaced, all others pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.verify import ResponseVerifier, json_string

VERIFIABLE = ("tool_call", "function_call")
MECHANISM = "Verdikt Streaming Interceptor"


def payload(item: Column) -> Column:
    """The tool call of an item as a response; ``tool_call`` unless null, else ``function_call``, else empty."""
    call = F.coalesce(F.when(F.get_json_object(item, "$.tool_call") != "null", F.get_json_object(item, "$.tool_call")), F.get_json_object(item, "$.function_call"), F.lit("{}"))
    name = F.coalesce(F.get_json_object(call, "$.name"), F.lit("unknown"))
    is_text = F.try_parse_json(F.get_json_object(call, "$.arguments")).isNull() & F.get_json_object(call, "$.arguments").isNotNull()
    value = F.when(is_text, json_string(F.get_json_object(call, "$.arguments"))).otherwise(F.coalesce(F.get_json_object(call, "$.arguments"), F.lit("{}")))
    return F.concat(F.lit('{"type":"tool_call","tool_name":'), json_string(name), F.lit(',"arguments":'), value, F.lit(',"raw_item":'), item, F.lit("}"))


def verify_stream(items: DataFrame, verifier: ResponseVerifier, item: str = "item", block_on_failure: bool = True) -> DataFrame:
    """One row out for each in: ``out_item``, ``outcome`` (passed, verified, blocked), ``verified``, ``block_reason``.

    A projection without state: for batch and streaming DataFrames alike."""
    kind = F.get_json_object(F.col(item), "$.type")
    routed = items.withColumn("_check", F.coalesce(kind.isin(*VERIFIABLE), F.lit(False)))
    routed = routed.withColumn("_payload", F.when(F.col("_check"), payload(F.col(item))))
    out = verifier.verify(routed, raw="_payload")
    name = F.get_json_object("_payload", "$.tool_name")
    reason = F.coalesce("block_reason", F.lit("verification failed"))
    replaced = F.to_json(
        F.struct(
            F.lit("system_intervention").alias("type"),
            F.lit("blocked").alias("status"),
            name.alias("tool_name"),
            F.concat(F.lit("blocked "), name, F.lit(": "), reason).alias("reason"),
            F.struct("guards_passed", "guards_failed", F.lit(MECHANISM).alias("mechanism")).alias("verification"),
        )
    )
    stopped = F.col("_check") & ~F.col("verified")
    return out.select(
        *items.columns,
        (F.when(stopped, replaced).otherwise(F.col(item)) if block_on_failure else F.col(item)).alias("out_item"),
        F.when(~F.col("_check"), "passed").when(F.col("verified"), "verified").otherwise("blocked").alias("outcome"),
        F.when(F.col("_check"), F.col("verified")).alias("verified"),
        F.when(stopped, reason).alias("block_reason"),
    )


def stream_stats(outcomes: DataFrame) -> DataFrame:
    """total, verified, blocked; over a stream use output mode complete."""
    return outcomes.groupBy().agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "verified").alias("verified"), F.count_if(F.col("outcome") == "blocked").alias("blocked"))


def on_blocked(callback: Callable[[dict], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that calls back for each blocked row, streamed through the driver one by one; errors of the callback are swallowed."""
    import logging

    def run(batch: DataFrame, _: int) -> None:
        rows: Iterator = batch.where("outcome = 'blocked'").toLocalIterator()
        for row in rows:
            try:
                callback(row.asDict(recursive=True))
            except Exception:  # noqa: BLE001
                logging.getLogger(__name__).exception("callback failed")

    return run
