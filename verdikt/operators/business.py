"""Tax, finance and contract guards.

Their calculations belong to engines that the caller injects: functions of columns that give
struct<verified:boolean, message:string>.  Routing, validation and the reading of results are here.  ``npv_engine`` is
our own: NPV = sum of cash flow t over (1 + rate) to the power t, t from 0, within a tolerance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import NUMBER_KINDS, Known, bound, first_truthy, get, has, is_array, is_number, is_object, is_string, items, kind, known, number, shown, text, truthy, type_name
from .base import Guard, Response

# Places that count as the United States.
US_STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC AS GU MP PR VI".split()
)
US_STATE_NAMES = (
    "ALABAMA", "ALASKA", "ARIZONA", "ARKANSAS", "CALIFORNIA", "COLORADO", "CONNECTICUT", "DELAWARE", "FLORIDA", "GEORGIA", "HAWAII", "IDAHO", "ILLINOIS", "INDIANA", "IOWA", "KANSAS", "KENTUCKY", "LOUISIANA", "MAINE", "MARYLAND", "MASSACHUSETTS", "MICHIGAN", "MINNESOTA", "MISSISSIPPI", "MISSOURI", "MONTANA", "NEBRASKA", "NEVADA", "NEW HAMPSHIRE", "NEW JERSEY", "NEW MEXICO", "NEW YORK", "NORTH CAROLINA", "NORTH DAKOTA", "OHIO", "OKLAHOMA", "OREGON", "PENNSYLVANIA", "RHODE ISLAND", "SOUTH CAROLINA", "SOUTH DAKOTA", "TENNESSEE", "TEXAS", "UTAH", "VERMONT", "VIRGINIA", "WASHINGTON", "WEST VIRGINIA", "WISCONSIN", "WYOMING", "DISTRICT OF COLUMBIA",
)
REQUIRED_CLAUSES = ("termination", "governing_law", "force_majeure")

Engine = Callable[..., Column]


def normalize_country(code: Column) -> Column:
    """Trimmed upper case; states and territories of the US as US; '' for NULL."""
    plain = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return F.when(plain.isin([*US_STATES, *US_STATE_NAMES]), F.lit("US")).otherwise(plain)


def required(name: str, **engines: Engine | None) -> None:
    missing = [k for k, e in engines.items() if e is None]
    if missing:
        raise ImportError(f"{name} needs engines: {', '.join(missing)}")


class TaxGuard(Guard):
    name = "TaxGuard"

    def __init__(self, payroll: Engine | None = None, wire: Engine | None = None, crypto: Engine | None = None):
        required(self.name, payroll=payroll, wire=wire, crypto=crypto)
        self.payroll, self.wire, self.crypto = payroll, wire, crypto

    def told(self, result: Column, default: str) -> Column:
        message = F.coalesce(F.when(result["message"] != "", result["message"]), F.lit(default))
        return F.when(F.coalesce(result["verified"], F.lit(False)), self.passes()).otherwise(self.fails(message))

    def column(self, r: Response) -> Column:
        a = F.coalesce(get(r.value, "arguments"), F.parse_json(F.lit("{}")))
        tool = F.coalesce(F.when(is_string(get(r.value, "tool_name")), text(get(r.value, "tool_name"))), F.lit(""))
        amount = lambda k: F.coalesce(number(first_truthy(get(a, k))), F.lit(0.0))
        table = lambda k: F.coalesce(F.try_variant_get(a, f'$["{k}"]', "map<string,double>"), F.create_map().cast("map<string,double>"))
        missing = F.array_compact(F.array(*[F.when(~has(a, k), F.lit(k)) for k in ("gross_ytd", "claimed_tax")])).cast("array<string>")
        purpose = F.coalesce(text(first_truthy(get(a, "purpose"))), F.lit(""))
        return (
            F.when(~is_object(r.value), self.fails(F.concat(F.lit("Invalid response type: expected dict, got "), type_name(r.value))))
            .when(~is_object(a), self.fails("Invalid arguments: expected object"))
            .when((tool == "process_payroll") & (F.size(missing) > 0), self.fails(F.concat(F.lit("Missing required payroll fields: "), F.array_join(missing, ", "))))
            .when(tool == "process_payroll", self.told(self.payroll(number(get(a, "gross_ytd")), amount("current"), number(get(a, "claimed_tax"))), "FICA tax verification failed"))
            .when(tool == "send_international_wire", self.told(self.wire(amount("amount_usd"), purpose, amount("ytd_usage")), "LRS limit exceeded"))
            .when(tool == "calculate_crypto_tax", self.told(self.crypto(table("losses"), table("gains")), "Set-off limit breached"))
            .otherwise(self.fails(F.concat(F.lit("No tax guard for tool: "), tool)))
        )


def npv_engine(tolerance: float = 0.01) -> Engine:
    def run(cashflows: Column, rate: Column, said: Column) -> Column:
        value = F.aggregate(F.transform(cashflows, lambda c, t: c / F.pow(1 + rate, t)), F.lit(0.0), lambda a, x: a + x)
        message = lambda x, wrong: F.concat(F.lit("NPV verification failed (difference="), wrong.cast("string"), F.lit("; computed="), x["value"].cast("string"), F.lit("; llm_val="), x["said"].cast("string"), F.lit(")"))
        told = lambda x, wrong: bound(wrong <= tolerance, lambda ok: F.struct(ok.alias("verified"), F.when(~F.coalesce(ok, F.lit(False)), message(x, wrong)).alias("message")))
        return bound(F.struct(value.alias("value"), said.alias("said")), lambda x: told(x, F.abs(x["value"] - x["said"])))

    run.expressions_only = True  # no Python, so it may stand in a lambda
    return run


class FinanceGuard(Guard):
    name = "FinanceGuard"

    def __init__(self, npv: Engine | None = None):
        required(self.name, npv=npv)
        self.npv = npv

    def column(self, r: Response) -> Column:
        # The caller's engine stays outside of lambdas, where it may be Python.
        of_type = lambda v: F.when(truthy(v), v.value)
        given = known(F.coalesce(get(r.context, "context"), get(r.context, "type")), of_type)
        context = F.coalesce(F.when(is_string(r.context), text(r.context)), text(F.coalesce(given, first_truthy(get(r.value, "context"), get(r.value, "type")))), F.lit(""))
        flows, said, rate = get(r.value, "cashflows"), get(r.value, "npv"), known(get(r.value, "discount_rate"), lambda v: F.when(is_number(v), number(v)).otherwise(F.lit(0.0)))
        kinds = lambda v: F.transform(items(v), kind)
        read = F.struct(flows.alias("flows"), said.alias("said"), context.alias("context"), kinds(flows).alias("kinds"), rate.alias("rate"))
        not_object = self.fails(F.concat(F.lit("Invalid response type: expected dict, got "), type_name(r.value)))
        if getattr(self.npv, "expressions_only", False):
            asked = lambda x: self.npv(F.transform(items(x["flows"]), number), x["rate"], number(x["said"]))
            checked = lambda x: bound(self.wrong(x), lambda w: F.when(w.isNotNull(), self.fails(w)).otherwise(bound(asked(x), self.of_result)))
            return F.when(~is_object(r.value), not_object).otherwise(bound(read, checked))
        wrong = bound(read, self.wrong)
        parts = F.struct(wrong.alias("wrong"), F.when(wrong.isNull(), self.npv(F.transform(items(flows), number), rate, number(said))).alias("result"))
        return F.when(~is_object(r.value), not_object).otherwise(bound(parts, self.verdict))

    def wrong(self, x: Column) -> Column:
        """What keeps the engine from being asked, or NULL."""
        flows, said, context, kinds = x["flows"], x["said"], x["context"], x["kinds"]
        both, one = flows.isNotNull() & said.isNotNull(), flows.isNotNull() | said.isNotNull()
        return (
            F.when(context == "payment_instruction", F.lit("ISO verification for payment_instruction not implemented"))
            .when(both & kinds.isNull(), F.concat(F.lit("Invalid 'cashflows': expected list, got "), type_name(flows)))
            .when(both & F.exists(kinds, lambda k: k == "VOID"), F.lit("Invalid 'cashflows': list contains null entries"))
            .when(both & F.exists(kinds, lambda k: ~k.rlike(NUMBER_KINDS)), F.lit("Invalid 'cashflows': list contains non-numeric entries"))
            .when(both & (kind(said) == "VOID"), F.lit("Invalid 'npv': value must not be null"))
            .when(both, F.lit(None).cast("string"))
            .when(one & context.isin("", "npv"), F.concat(F.lit("Missing required field: '"), F.when(flows.isNotNull(), F.lit("npv")).otherwise(F.lit("cashflows")), F.lit("' for NPV calculation")))
            .otherwise(F.concat(F.lit("Unrecognized finance context: "), context))
        )

    def verdict(self, x: Column) -> Column:
        return F.when(x["wrong"].isNotNull(), self.fails(x["wrong"])).otherwise(self.of_result(x["result"]))

    def of_result(self, result: Column) -> Column:
        return F.when(F.coalesce(result["verified"], F.lit(False)), self.passes()).otherwise(self.fails(F.coalesce(result["message"], F.lit("NPV verification failed"))))


class LegalGuard(Guard):
    name = "LegalGuard"

    def __init__(self, choice_of_law: Engine | None = None):
        """choice_of_law: (parties array<string>, governing_law, forum) -> struct<verified, message>; a NULL result is
        an error of the engine, which only warns."""
        required(self.name, choice_of_law=choice_of_law)
        self.choice_of_law = choice_of_law

    def column(self, r: Response) -> Column:
        # The caller's engine stays outside of lambdas, where it may be Python; what reads its result is computed once.
        v, none = r.value, F.array().cast("array<string>")
        string = lambda k: known(get(v, k), lambda x: F.when(is_string(x), text(x)))
        country = lambda p: known(p, lambda x: bound(F.when(is_string(x), text(x)), normalize_country))
        listed = lambda xs: F.transform(F.filter(items(xs), truthy), country)
        own = bound(bound(string("jurisdiction"), normalize_country), lambda c: F.when(c != "", F.array(c)).otherwise(none))
        parties = known(get(v, "parties_countries"), lambda xs: F.when(is_array(xs), listed(xs)).otherwise(own))
        result = self.choice_of_law(parties, text(get(v, "governing_law")), text(get(v, "forum")))
        asked = has(v, "governing_law") & has(v, "forum")
        law = bound(F.struct(asked.alias("asked"), F.size(parties).alias("parties"), result.alias("result")), self.law)
        clauses = known(get(v, "clauses"), self.clauses)
        parts = F.struct(law.alias("law"), clauses.alias("clauses"), F.upper(F.trim(F.coalesce(string("jurisdiction"), F.lit("")))).alias("place"), self.term(string("type"), get(v, "term_years")).alias("term"))
        not_object = self.fails(F.concat(F.lit("Invalid response type: expected dict, got "), type_name(v)))
        return F.when(~is_object(v), not_object).otherwise(bound(parts, self.verdict))

    def law(self, x: Column) -> Column:
        """struct<skipped, mismatch>, both messages."""
        result = x["result"]
        skipped = F.when(x["parties"] == 0, F.lit("Jurisdiction check skipped (missing party country information)")).when(result.isNull(), F.lit("Jurisdiction check skipped: internal error (API mismatch)"))
        mismatch = F.when((x["parties"] > 0) & ~F.coalesce(result["verified"], F.lit(True)), F.coalesce(result["message"], F.lit("Jurisdiction Mismatch")))
        return F.struct(F.when(x["asked"], skipped).alias("skipped"), F.when(x["asked"], mismatch).alias("mismatch"))

    def clauses(self, v: Known) -> Column:
        """struct<bad, types> of the clauses."""
        name = lambda c: known(get(c, "type"), lambda t: F.when(is_string(t), text(t)))
        types = F.coalesce(F.transform(F.filter(items(v), is_object), name), F.array().cast("array<string>"))
        made = lambda there: F.struct((there & ~is_array(v) & ~is_string(v) & ~is_object(v)).alias("bad"), F.when(there, types).otherwise(F.array().cast("array<string>")).alias("types"))
        return bound(truthy(v), made)

    def term(self, kind_: Column, years: Column) -> Column:
        long = lambda y: F.when(is_number(y) & (number(y) > 5), F.concat(F.lit("UNREASONABLE_TERM: "), shown(y), F.lit(" year term for NDA exceeds standard commercial practice (typically 2-5 years).")))
        return F.when(kind_ == "NDA", known(years, long))

    def verdict(self, x: Column) -> Column:
        none, types = F.array().cast("array<string>"), x["clauses"]["types"]
        banned = F.when(x["place"].isin("CA", "CALIFORNIA"), F.transform(F.filter(types, lambda t: t == "non_compete"), lambda t: F.lit("PROHIBITED_CLAUSE: Non-compete clauses are unenforceable in California."))).otherwise(none)
        incomplete = lambda missing: F.when(F.size(missing) > 0, F.concat(F.lit("COMPLETENESS_WARNING: Missing standard clauses: ['"), F.array_join(missing, "', '"), F.lit("']")))
        missing = F.array_except(F.array(*map(F.lit, REQUIRED_CLAUSES)), types)
        flags = F.array_compact(F.concat(F.array(x["law"]["mismatch"]), banned, F.array(x["term"])))
        warnings = F.array_compact(F.array(x["law"]["skipped"], bound(missing, incomplete)))
        told = bound(F.struct(flags.alias("flags"), warnings.alias("warnings")), self.told)
        return F.when(x["clauses"]["bad"], self.crash("clauses are not a list")).otherwise(told)

    def told(self, x: Column) -> Column:
        flags, warnings = x["flags"], x["warnings"]
        return (
            F.when(F.size(flags) > 0, self.fails(F.array_join(flags, "; "), F.struct(flags.alias("flags"), F.when(F.size(warnings) > 0, warnings).alias("warnings"))))
            .when(F.size(warnings) > 0, self.warns(F.array_join(warnings, "; "), F.struct(warnings.alias("warnings"))))
            .otherwise(self.passes())
        )
