"""JSON Schema (draft 7) and required fields.

Flat object schemas become column expressions.  All others are checked by ``errors``, a plain validator of the
standard, in Arrow batches; both give the same number of errors.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regexes import searched
from ..functions.values import bound, get, has, is_array, is_boolean, is_integer, is_object, is_string, kind, known, number, text
from .argument import equal
from .base import Guard, Response

FLAT = {"type", "required", "properties", "additionalProperties", "$schema", "title", "description"}
LEAF = {"type", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "enum", "const", "pattern", "title", "description"}
TYPES = ("string", "number", "integer", "boolean", "null", "object", "array")


def of_type(x, t: str) -> bool:
    number_ = isinstance(x, (int, float)) and not isinstance(x, bool)
    return {"string": isinstance(x, str), "number": number_, "integer": number_ and (isinstance(x, int) or x.is_integer()), "boolean": isinstance(x, bool), "null": x is None, "object": isinstance(x, dict), "array": isinstance(x, list)}.get(t, False)


def same(a, b) -> bool:
    """JSON equality: booleans are not numbers."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return type(a) is type(b) and a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and a == b


def errors(x, schema, root=None, at: str = "$"):
    """(path, message) of each violation; sub-schemas of anyOf, oneOf, not and if count as one."""
    root = schema if root is None else root
    if schema is True or schema == {}:
        return
    if schema is False:
        yield at, f"False schema does not allow {x!r}"
        return
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].lstrip("#").strip("/").split("/") if schema["$ref"] != "#" else ():
            part = part.replace("~1", "/").replace("~0", "~")
            target = target[int(part)] if isinstance(target, list) else target[part]
        yield from errors(x, target, root, at)
        return
    ok = lambda s: next(errors(x, s, root, at), None) is None
    numeric = isinstance(x, (int, float)) and not isinstance(x, bool)
    for k, v in schema.items():
        if k == "type" and not any(of_type(x, t) for t in ([v] if isinstance(v, str) else v)):
            yield at, f"{x!r} is not of type {v!r}"
        elif k == "enum" and not any(same(x, e) for e in v):
            yield at, f"{x!r} is not one of {v!r}"
        elif k == "const" and not same(x, v):
            yield at, f"{v!r} was expected"
        elif numeric and (k == "minimum" and x < v or k == "maximum" and x > v or k == "exclusiveMinimum" and x <= v or k == "exclusiveMaximum" and x >= v):
            yield at, f"{x!r} violates {k} {v!r}"
        elif numeric and k == "multipleOf" and (x % v != 0 if isinstance(x, int) and isinstance(v, int) else not float(x / v).is_integer()):
            yield at, f"{x!r} is not a multiple of {v!r}"
        elif isinstance(x, str) and (k == "minLength" and len(x) < v or k == "maxLength" and len(x) > v):
            yield at, f"{x!r} violates {k} {v!r}"
        elif isinstance(x, str) and k == "pattern" and not re.search(v, x):
            yield at, f"{x!r} does not match {v!r}"
        elif k == "allOf":
            for s in v:
                yield from errors(x, s, root, at)
        elif k == "anyOf" and not any(map(ok, v)) or k == "oneOf" and sum(map(ok, v)) != 1:
            yield at, f"{x!r} is not valid under {k}"
        elif k == "not" and ok(v):
            yield at, f"{x!r} should not be valid under {v!r}"
        elif k == "if" and (branch := schema.get("then" if ok(v) else "else")) is not None:
            yield from errors(x, branch, root, at)
        elif isinstance(x, list):
            yield from array_errors(x, k, v, schema, root, at)
        elif isinstance(x, dict):
            yield from object_errors(x, k, v, schema, root, at)


def array_errors(x, k, v, schema, root, at):
    if k == "items" and not isinstance(v, list):
        for i, e in enumerate(x):
            yield from errors(e, v, root, f"{at}[{i}]")
    elif k == "items":
        for i, (e, s) in enumerate(zip(x, v)):
            yield from errors(e, s, root, f"{at}[{i}]")
    elif k == "additionalItems" and isinstance(schema.get("items"), list):
        rest = list(enumerate(x))[len(schema["items"]) :]
        if v is False and rest:
            yield at, "Additional items are not allowed"
        elif v is not False:
            for i, e in rest:
                yield from errors(e, v, root, f"{at}[{i}]")
    elif k == "minItems" and len(x) < v or k == "maxItems" and len(x) > v:
        yield at, f"{x!r} violates {k} {v!r}"
    elif k == "uniqueItems" and v and any(same(a, b) for i, a in enumerate(x) for b in x[:i]):
        yield at, f"{x!r} has non-unique elements"
    elif k == "contains" and not any(next(errors(e, v, root, at), None) is None for e in x):
        yield at, f"None of {x!r} are valid under the given schema"


def object_errors(x, k, v, schema, root, at):
    where = lambda name: f"{at}.{name}" if re.fullmatch(r"[A-Za-z_]\w*", name) else f"{at}[{name!r}]"
    if k == "properties":
        for name, s in v.items():
            if name in x:
                yield from errors(x[name], s, root, where(name))
    elif k == "patternProperties":
        for p, s in v.items():
            for name in x:
                if re.search(p, name):
                    yield from errors(x[name], s, root, where(name))
    elif k == "additionalProperties":
        extra = [n for n in x if n not in schema.get("properties", {}) and not any(re.search(p, n) for p in schema.get("patternProperties", {}))]
        if v is False and extra:
            yield at, f"Additional properties are not allowed ({', '.join(map(repr, extra))})"
        elif isinstance(v, dict):
            for name in extra:
                yield from errors(x[name], v, root, where(name))
    elif k == "required":
        for name in v:
            if name not in x:
                yield at, f"{name!r} is a required property"
    elif k == "minProperties" and len(x) < v or k == "maxProperties" and len(x) > v:
        yield at, f"{x!r} violates {k} {v!r}"
    elif k == "propertyNames":
        for name in x:
            yield from errors(name, v, root, at)
    elif k == "dependencies":
        for name, need in v.items():
            if name in x and isinstance(need, list):
                for other in need:
                    if other not in x:
                        yield at, f"{other!r} is a dependency of {name!r}"
            elif name in x:
                yield from errors(x, need, root, at)


def is_flat(schema) -> bool:
    if not isinstance(schema, dict) or schema.get("type") != "object" or set(schema) - FLAT or not isinstance(schema.get("additionalProperties", True), bool):
        return False
    plain = lambda v: isinstance(v, (str, int, float, bool)) and not (isinstance(v, float) and math.isnan(v))
    return all(isinstance(s, dict) and not set(s) - LEAF and isinstance(s.get("type", ""), str) and s.get("type", TYPES[0]) in TYPES and all(map(plain, [*s.get("enum", []), *([s["const"]] if "const" in s else [])])) for s in schema.get("properties", {}).values())


class SchemaGuard(Guard):
    name = "SchemaGuard"

    def __init__(self, schema: dict, strict: bool = True, allow_additional_properties: bool = False):
        """The flags are kept and have no effect."""
        self.schema, self.strict, self.additional = schema, strict, allow_additional_properties

    @staticmethod
    def target(r: Response) -> Column:
        return F.coalesce(get(r.value, "output"), get(r.value, "content"), r.value)

    def leaf_errors(self, name: str, s: dict, v: Column) -> list[Column]:
        k, out = kind(v), []
        real = k.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        tests = {"string": is_string(v), "number": real, "integer": is_integer(v) | (real & (number(v) == F.floor(number(v)))), "boolean": is_boolean(v), "null": k == "VOID", "object": is_object(v), "array": is_array(v)}
        strictly = lambda x: equal(v, x) & (is_boolean(v) == F.lit(isinstance(x, bool)))
        add = lambda wrong, message: out.append(F.when(wrong, F.lit(f"$.{name}: {message}")))
        for key, x in s.items():
            if key == "type":
                add(~tests[x], f"not of type '{x}'")
            elif key in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
                n = number(v)
                add(real & {"minimum": n < x, "maximum": n > x, "exclusiveMinimum": n <= x, "exclusiveMaximum": n >= x}[key], f"violates {key} {x}")
            elif key in ("minLength", "maxLength"):
                n = F.length(text(v))
                add(is_string(v) & (n < x if key == "minLength" else n > x), f"violates {key} {x}")
            elif key == "pattern":
                add(is_string(v) & ~searched(text(v), x), f"does not match '{x}'")
            elif key in ("enum", "const"):
                ok = F.lit(False)
                for e in x if key == "enum" else [x]:
                    ok = ok | F.coalesce(strictly(e), F.lit(False))
                add(~ok, f"not one of {x}" if key == "enum" else f"{x} was expected")
        return out

    def flat_errors(self, data: Column) -> Column:
        none = F.array().cast("array<string>")
        if_any = lambda out: F.array(*out).cast("array<string>") if out else none
        inside = []
        for key, x in self.schema.items():
            if key == "required":
                inside += [F.array(F.when(~has(data, n), F.lit(f"$: '{n}' is a required property"))) for n in x]
            elif key == "properties":
                inside += [known(get(data, n), lambda v, n=n, s=s: F.when(v.value.isNull(), none).otherwise(if_any(self.leaf_errors(n, s, v)))) for n, s in x.items()]
            elif key == "additionalProperties" and x is False:
                unknown = F.array_except(F.map_keys(F.try_variant_get(data, "$", "map<string,variant>")), F.array(*map(F.lit, self.schema.get("properties", {}))).cast("array<string>"))
                inside.append(bound(unknown, lambda extra: F.array(F.when(F.size(extra) > 0, F.concat(F.lit("$: Additional properties are not allowed ("), F.array_join(extra, ", "), F.lit(")"))))))
        errors_ = F.array_compact(F.flatten(F.array(*inside))) if inside else none
        return F.when(is_object(data), errors_).otherwise(F.array(F.lit("$: not of type 'object'")))

    def column(self, r: Response) -> Column:
        if is_flat(self.schema):
            found = bound(bound(self.target(r), self.flat_errors), self.verdict)
            return F.when(~is_object(r.value), self.crash("invalid schema or response")).otherwise(found)
        else:
            schema = self.schema

            @F.pandas_udf("array<string>")
            def run(data: pd.Series) -> pd.Series:
                def one(x):
                    try:
                        return [f"{p}: {m}" for p, m in errors(json.loads(x), schema)]
                    except Exception:  # noqa: BLE001  a schema that is not one
                        return None

                return data.map(one)

            out = run(F.to_json(self.target(r)))
            found, crashed = F.coalesce(out, F.array().cast("array<string>")), out.isNull()
        return F.when(~is_object(r.value) | crashed, self.crash("invalid schema or response")).otherwise(self.verdict(found))  # Python may not stand in a lambda's argument

    def verdict(self, found: Column) -> Column:
        details = F.struct(F.slice(found, 1, 10).alias("errors"), F.size(found).alias("total_errors"))
        failed = self.fails(F.format_string("Schema validation failed: %d error(s)", F.size(found)), details)
        return F.when(F.size(found) > 0, failed).otherwise(self.passes("Schema validation passed", F.struct(F.lit(True).alias("schema_valid"))))


class RequiredFieldsGuard(Guard):
    name = "RequiredFieldsGuard"

    def __init__(self, fields: list[str]):
        self.fields = fields

    def column(self, r: Response) -> Column:
        data = F.coalesce(get(r.value, "output"), r.value)
        missing = F.array_compact(F.array(*[F.when(~has(data, f), F.lit(f)) for f in self.fields])).cast("array<string>")
        return (
            F.when(~is_object(r.value), self.crash("not an object"))
            .when(~is_object(data), self.fails("Response is not a dictionary"))
            .when(F.size(missing) > 0, self.fails(F.concat(F.lit("Missing required fields: "), F.array_join(missing, ", ")), F.struct(missing.alias("missing_fields"))))
            .otherwise(self.passes())
        )
