"""Expressions over VARIANT values with the truth, type and text rules of dynamic objects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, make) -> Column:
    """make(value), where the value is computed once however often ``make`` uses it (as a lambda's variable, which no projection copies)."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


#: Kinds of numbers and booleans.
NUMBER_KINDS = "^(BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL)"


@dataclass(frozen=True)
class Known:
    """A value whose kind is computed already; every function here takes one in a value's place."""

    value: Column
    kind: Column


def known(v: Column, make) -> Column:
    """make(Known), where the value and its kind are computed once."""
    return bound(F.struct(v.alias("value"), kind(v).alias("kind")), lambda x: make(Known(x["value"], x["kind"])))


def plain(v: Column | Known) -> Column:
    return v.value if isinstance(v, Known) else v


def path(*keys: str) -> str:
    return "$" + "".join('["' + k.replace('"', '\\"') + '"]' for k in keys)


def get(v: Column, *keys: str) -> Column:
    """The value at a key: NULL if the key is missing, a variant null if it is null.

    One key is read as a struct's only field: Spark leaves the search of a path that is not there by an exception, which costs more
    than all else in a guard."""
    if len(keys) != 1 or not keys[0]:
        return F.try_variant_get(plain(v), path(*keys), "variant")
    return fields(v, keys[0]).getField(keys[0])


def fields(v: Column, *keys: str) -> Column:
    """A struct of the values at the keys, which are NULL if missing; NULL if v is no object."""
    named = ["`" + k.replace("`", "``") + "`:variant" for k in keys]
    return F.try_variant_get(plain(v), "$", f"struct<{','.join(named)}>")


def has(v: Column, key: str) -> Column:
    return get(v, key).isNotNull()


def kind(v: Column) -> Column:
    """STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID, OBJECT<..> or ARRAY<..>; '' if missing."""
    return v.kind if isinstance(v, Known) else F.coalesce(F.schema_of_variant(v), F.lit(""))


def is_object(v: Column) -> Column:
    """As a struct without fields, which looks at nothing inside; an object's kind lists all that it has."""
    return kind(v).startswith("OBJECT") if isinstance(v, Known) else F.try_variant_get(v, "$", "struct<>").isNotNull()


def is_array(v: Column) -> Column:
    return kind(v).startswith("ARRAY")


def is_string(v: Column) -> Column:
    return kind(v) == "STRING"


def is_boolean(v: Column) -> Column:
    return kind(v) == "BOOLEAN"


def is_integer(v: Column) -> Column:
    return kind(v) == "BIGINT"


def is_number(v: Column) -> Column:
    """Integers, fractions and booleans."""
    return kind(v).rlike(NUMBER_KINDS)


def text(v: Column) -> Column:
    return F.try_variant_get(plain(v), "$", "string")


def number(v: Column) -> Column:
    """As a double; also of number strings and booleans; NULL where that fails."""
    return F.try_variant_get(plain(v), "$", "double")


def truthy(v: Column) -> Column:
    """False for what is missing, null, false, zero or empty."""
    if not isinstance(v, Known):
        return known(v, truthy)
    rest = F.coalesce(~text(v).isin("0", "0.0", "-0.0", "false"), F.lit(False))
    first = F.try_variant_get(plain(v), "$[0]", "variant")
    return F.when(v.kind == "STRING", text(v) != "").when(v.kind.startswith("OBJECT"), v.kind != "OBJECT<>").when(v.kind.startswith("ARRAY"), first.isNotNull()).otherwise(rest)


def first_truthy(*values: Column) -> Column:
    return F.coalesce(*[known(v, lambda x: F.when(truthy(x), x.value)) for v in values])


def items(v: Column) -> Column:
    """An array's elements; NULL for anything else."""
    return F.try_variant_get(plain(v), "$", "array<variant>")


def type_name(v: Column) -> Column:
    k = kind(v)
    return (
        F.when(k == "STRING", F.lit("str"))
        .when(k == "BIGINT", F.lit("int"))
        .when(k == "BOOLEAN", F.lit("bool"))
        .when(k == "VOID", F.lit("NoneType"))
        .when(k.startswith("OBJECT"), F.lit("dict"))
        .when(k.startswith("ARRAY"), F.lit("list"))
        .otherwise(F.lit("float"))
    )


def shown(v: Column) -> Column:
    """How a value is written in messages."""
    k = kind(v)
    return F.when(k == "VOID", F.lit("None")).when(k == "BOOLEAN", F.initcap(text(v))).when(k.startswith("OBJECT") | k.startswith("ARRAY"), F.to_json(plain(v))).otherwise(text(v))


def shown_number(x: Column) -> Column:
    return x.cast("string")
