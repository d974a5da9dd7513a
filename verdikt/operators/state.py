"""Legal state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import Known, bound, first_truthy, get, is_array, is_object, known, text
from .base import Guard, Response


class StateGuard(Guard):
    name = "StateGuard"

    def __init__(self, transitions: dict[str, list[str]], current_state: str | None = None, state_field: str = "state", new_state_field: str = "new_state"):
        self.transitions, self.current, self.state_field, self.new_field = transitions, current_state, state_field, new_state_field
        self.states = sorted({*transitions, *(s for to in transitions.values() for s in to)})

    def legal(self, current: Column, new: Column) -> Column:
        ok = F.lit(False)
        for state, to in self.transitions.items():
            if to:
                ok = ok | ((current == state) & new.isin(list(to)))
        return ok

    def column(self, r: Response) -> Column:
        known_state = text(first_truthy(get(r.context, "current_state")))

        def of_data(data: Column) -> Column:
            given = [known_state] + ([F.lit(self.current)] if self.current else []) + [text(first_truthy(get(data, self.state_field)))]
            value = first_truthy(get(data, self.new_field), get(data, "status"))
            return bound(F.struct(is_object(data).alias("is_object"), F.coalesce(*given).alias("current"), value.alias("value")), lambda x: known(x["value"], lambda v: self.of_value(x, v)))

        return F.when(~is_object(r.value), self.crash("malformed state")).otherwise(bound(F.coalesce(get(r.value, "output"), r.value), of_data))

    def of_value(self, x: Column, value: Known) -> Column:
        malformed = ~x["is_object"] | is_object(value) | is_array(value)
        verdict = F.when(value.value.isNull(), self.passes("No state change detected")).otherwise(bound(text(value), lambda new: self.verdict(x["current"], new)))
        return F.when(malformed, self.crash("malformed state")).otherwise(verdict)

    def verdict(self, current: Column, new: Column) -> Column:
        next_states = F.lit(None).cast("array<string>")
        for state, to in self.transitions.items():
            next_states = F.when(current == state, F.array(*map(F.lit, to)).cast("array<string>")).otherwise(next_states)
        return (
            F.when(~new.isin(self.states) if self.states else F.lit(True), self.fails(F.format_string("Invalid state: '%s'", new), F.struct(new.alias("invalid_state"), F.array(*map(F.lit, self.states)).cast("array<string>").alias("valid_states"))))
            .when(current.isNull(), self.passes(F.format_string("State set to '%s'", new), F.struct(new.alias("new_state"))))
            .when(~F.coalesce(self.legal(current, new), F.lit(False)), self.fails(F.format_string("Invalid transition: '%s' -> '%s'", current, new), F.struct(current.alias("current_state"), new.alias("requested_state"), F.coalesce(next_states, F.array().cast("array<string>")).alias("valid_next_states"))))
            .otherwise(self.passes(F.format_string("Valid transition: '%s' -> '%s'", current, new), F.struct(current.alias("from"), new.alias("to"))))
        )


def with_previous_state(rows: DataFrame, entity: str, order: list[str], state: str) -> DataFrame:
    """Adds ``previous_state``: the entity's state in the row before, by ``order``.  A sort within entities, no collection."""
    return rows.withColumn("previous_state", F.lag(state).over(W.partitionBy(entity).orderBy(*order)))
