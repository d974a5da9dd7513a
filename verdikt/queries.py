"""Registered queries of the guards, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators.argument import ArgumentGuard
from .operators.business import FinanceGuard, LegalGuard, TaxGuard, npv_engine
from .operators.math import MathGuard
from .operators.safety import SafetyGuard
from .operators.schema import RequiredFieldsGuard, SchemaGuard
from .operators.state import StateGuard, with_previous_state
from .operators.tool import ToolGuard
from .plans.verify import ResponseVerifier, json_string, summary, tool_call
from .streaming.interceptor import stream_stats, verify_stream

#: name: (query, SQL)
REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt over all cores: a file of long work may have them in one row group, which a single task reads."""
    return rows.repartition(key)


def content(text: Column) -> Column:
    return F.concat(F.lit('{"type":"text","content":'), json_string(text), F.lit("}"))


def result(field: str, k: int = 0) -> Column:
    return F.get(F.col("guard_results"), F.lit(k))[field]


def checked(rows: DataFrame, raw: Column, *guards, context: Column | None = None) -> DataFrame:
    rows = rows.withColumn("raw", raw)
    if context is not None:
        rows = rows.withColumn("context", context)
    return ResponseVerifier(guards).verify(rows, context=None if context is None else "context")


def pii_found() -> Column:
    return F.coalesce(F.array_join(F.from_json(F.get_json_object(result("details"), "$.issues[0].details"), "array<string>"), ","), F.lit(""))


EMAIL, PHONE, SSN, CARD, IP = (
    r"(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
)


def pii_sql(column: str, names: str = "email phone ssn credit_card ip_address") -> str:
    patterns = dict(zip("email phone ssn credit_card ip_address".split(), (EMAIL, PHONE, SSN, CARD, IP)))
    cases = ", ".join(f"CASE WHEN regexp_matches({column}, '{patterns[n]}') THEN '{n}' END" for n in names.split())
    return f"concat_ws(',', {cases})"


@query(f"SELECT doc_id, p = '' AS verified, p AS pii FROM (SELECT doc_id, {pii_sql('text')} AS p FROM documents)")
def safety_pii_documents(spark, sf_dir):
    return checked(table(spark, sf_dir, "documents").select("doc_id", "text"), content(F.col("text")), SafetyGuard()).select("doc_id", "verified", pii_found().alias("pii"))


@query(f"SELECT page_id, p = '' AS verified, p AS pii FROM (SELECT page_id, {pii_sql('html')} AS p FROM pages)")
def safety_pii_pages(spark, sf_dir):
    guard = SafetyGuard(check_injection=False, check_harmful=False)
    return checked(table(spark, sf_dir, "pages").select("page_id", "html"), content(F.col("html")), guard).select("page_id", "verified", pii_found().alias("pii"))


@query(f"SELECT doc_id, p AS pii FROM (SELECT doc_id, {pii_sql('text', 'phone ssn credit_card ip_address')} AS p FROM documents)")
def safety_pii_allow_list(spark, sf_dir):
    return checked(table(spark, sf_dir, "documents").select("doc_id", "text"), content(F.col("text")), SafetyGuard(pii_allow_list=["email"])).select("doc_id", pii_found().alias("pii"))


@query(r"SELECT conv_id, turn, regexp_matches(role || ': ' || text, '(?i)system\s*:\s*') AS blocked FROM conversations")
def safety_injection_roles(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("said"))
    return checked(rows, content(F.col("said")), SafetyGuard(check_pii=False)).select("conv_id", "turn", "blocked")


@query(r"SELECT doc_id, regexp_matches(text, '(?i)token\s*[=:]\s*\S+') AS blocked FROM documents")
def safety_custom_pattern(spark, sf_dir):
    guard = SafetyGuard(check_pii=False, check_injection=False, check_harmful=False, custom_patterns=[r"(?i)token\s*[=:]\s*\S+"])
    return checked(table(spark, sf_dir, "documents").select("doc_id", "text"), content(F.col("text")), guard).select("doc_id", "blocked")


@query("SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) > 1000 AS over_budget FROM conversations")
def safety_token_budget(spark, sf_dir):
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"), F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("used"))
    raw = F.to_json(F.struct(F.struct(F.col("n").alias("total_tokens")).alias("usage")))
    return checked(rows, raw, SafetyGuard(max_tokens=1000), context=F.to_json(F.struct(F.col("used").alias("total_tokens")))).select("conv_id", "turn", F.col("blocked").alias("over_budget"))


@query("SELECT event_id, event_type IN ('error', 'purchase') AS blocked, CASE WHEN event_type IN ('error', 'purchase') THEN 'BLOCKED: Tool ''' || event_type || ''' is not allowed' ELSE 'All 1 tool call(s) verified' END AS message FROM events")
def tool_blocklist(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return checked(rows, tool_call(F.col("event_type"), F.col("props")), ToolGuard(blocked_tools=["error", "purchase"])).select("event_id", "blocked", result("message").alias("message"))


@query("SELECT event_id, event_type NOT IN ('view', 'click') AS blocked FROM events")
def tool_whitelist(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return checked(rows, tool_call(F.col("event_type"), F.col("props")), ToolGuard(allowed_tools=["view", "click"])).select("event_id", "blocked")


@query("""SELECT event_id, regexp_matches(props, '"k": ?9[0-9]') AS blocked FROM events""")
def tool_argument_pattern(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return checked(rows, tool_call(F.col("event_type"), F.col("props")), ToolGuard(dangerous_patterns=[r'"k": ?9\d'])).select("event_id", "blocked")


@query("SELECT l_orderkey, count(*) AS n_calls, count(*) > 10 AS blocked FROM lineitem GROUP BY l_orderkey")
def tool_max_calls(spark, sf_dir):
    call = F.struct(F.lit("ship").alias("tool_name"), F.struct("l_partkey").alias("arguments"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(call).alias("tool_calls"))  # the lines of one order
    return checked(rows, F.to_json(F.struct("tool_calls")), ToolGuard()).select("l_orderkey", F.size("tool_calls").cast("long").alias("n_calls"), "blocked")


@query("SELECT event_id, k <= 80 AND event_type <> 'error' AS verified, (k > 80)::INT + (event_type = 'error')::INT AS n_errors FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)")
def schema_props(spark, sf_dir):
    schema = {"type": "object", "required": ["k", "kind"], "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 80}, "kind": {"type": "string", "enum": ["view", "signup", "purchase", "click"]}}, "additionalProperties": False}
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    raw = F.to_json(F.struct(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("kind")).alias("output")))
    return checked(rows, raw, SchemaGuard(schema)).select("event_id", "verified", F.coalesce(F.get_json_object(result("details"), "$.total_errors").cast("int"), F.lit(0)).alias("n_errors"))


@query("SELECT event_id, k >= 50 AS verified FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)")
def schema_conditional(spark, sf_dir):
    schema = {"$ref": "#/definitions/e", "definitions": {"e": {"oneOf": [{"properties": {"k": {"minimum": 50}}}, {"not": {"required": ["k"]}}]}}}
    rows = table(spark, sf_dir, "events").select("event_id", "props")
    return checked(rows, F.concat(F.lit('{"output":'), "props", F.lit("}")), SchemaGuard(schema)).select("event_id", "verified")


@query("SELECT event_id, event_type = 'purchase' AS verified, CASE WHEN event_type = 'purchase' THEN 'RequiredFieldsGuard passed' ELSE 'Missing required fields: amount' END AS message FROM events")
def required_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    raw = F.to_json(F.struct(F.struct(F.col("event_type").alias("kind"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount")).alias("output")))
    return checked(rows, raw, RequiredFieldsGuard(["kind", "amount"])).select("event_id", "verified", result("message").alias("message"))


LINE = ["l_orderkey", "l_linenumber"]


@query("SELECT l_orderkey, l_linenumber, l_partkey % 7 <> 0 AS verified FROM lineitem")
def math_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*LINE, "l_partkey", "l_extendedprice", "l_discount", "l_tax")
    off = F.when(F.col("l_partkey") % 7 == 0, 1.0).otherwise(0.0)
    part = F.round(F.col("l_extendedprice") * F.col("l_discount"), 2)
    tax = F.round(F.col("l_extendedprice") * F.col("l_tax"), 2)
    output = F.struct(F.col("l_extendedprice").alias("subtotal"), part.alias("discount"), tax.alias("tax"), (F.col("l_extendedprice") - part + tax + off).alias("total"))
    return checked(rows, F.to_json(F.struct(output.alias("output"))), MathGuard()).select(*LINE, "verified")


@query("SELECT l_orderkey, l_linenumber, l_partkey % 5 <> 0 AS verified FROM lineitem")
def math_percent(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*LINE, "l_partkey", "l_extendedprice", "l_tax")
    off = F.when(F.col("l_partkey") % 5 == 0, 0.5).otherwise(0.0)
    output = F.struct(F.col("l_extendedprice").alias("price"), (F.col("l_tax") * 100).alias("price_percent"), (F.col("l_extendedprice") * F.col("l_tax") + off).alias("price_amount"))
    return checked(rows, F.to_json(F.struct(output.alias("output"))), MathGuard()).select(*LINE, "verified")


@query("SELECT l_orderkey, l_linenumber, (l_quantity < 5 OR l_quantity > 40)::INT + (abs(l_tax - 0.04) > 0.01)::INT AS n_errors FROM lineitem")
def math_custom(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*LINE, "l_quantity", "l_tax")
    rules = [{"type": "range", "field": "l_quantity", "min": 5, "max": 40}, {"type": "equals", "field": "l_tax", "expected": 0.04}]
    out = checked(rows, F.to_json(F.struct(F.struct("l_quantity", "l_tax").alias("output"))), MathGuard(custom_rules=rules))
    return out.select(*LINE, F.coalesce(F.json_array_length(F.get_json_object(result("details"), "$.errors")), F.lit(0)).alias("n_errors"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey % 3 <> 0 AS verified FROM lineitem")
def math_inline(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*LINE, "l_quantity", "l_suppkey")
    n = F.col("l_quantity").cast("long")
    said = F.concat(F.lit("We ship "), n.cast("string"), F.lit(" * 2 = "), (n * 2 + F.when(F.col("l_suppkey") % 3 == 0, 1).otherwise(0)).cast("string"), F.lit(" pieces"))
    return checked(rows, F.to_json(F.struct(said.alias("output"))), MathGuard()).select(*LINE, "verified")


STEPS = {"view": ["click", "view"], "click": ["purchase", "view"], "purchase": ["view"], "signup": ["view", "click"]}


@query("""WITH s AS (SELECT event_id, event_type AS t, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, CASE WHEN t NOT IN ('view', 'click', 'purchase', 'signup') THEN false WHEN p IS NULL THEN true ELSE
(p = 'view' AND t IN ('click', 'view')) OR (p = 'click' AND t IN ('purchase', 'view')) OR (p = 'purchase' AND t = 'view') OR (p = 'signup' AND t IN ('view', 'click')) END AS verified FROM s""")
def state_events(spark, sf_dir):
    rows = with_previous_state(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type")
    raw, context = F.to_json(F.struct(F.col("event_type").alias("new_state"))), F.to_json(F.struct(F.col("previous_state").alias("current_state")))
    return checked(rows, raw, StateGuard(STEPS), context=context).select("event_id", "verified")


@query("""WITH s AS (SELECT o_orderkey, o_orderstatus AS t, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
SELECT o_orderkey, CASE WHEN p IS NULL THEN 'State set to ''' || t || '''' WHEN p || t IN ('OP', 'PF', 'FF') THEN 'Valid transition: ''' || p || ''' -> ''' || t || '''' ELSE 'Invalid transition: ''' || p || ''' -> ''' || t || '''' END AS message FROM s""")
def state_orders(spark, sf_dir):
    rows = with_previous_state(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")
    raw = F.to_json(F.struct(F.struct(F.col("previous_state").alias("state"), F.col("o_orderstatus").alias("status")).alias("output")))
    return checked(rows, raw, StateGuard({"O": ["P"], "P": ["F"], "F": ["F"]})).select("o_orderkey", result("message").alias("message"))


@query("""SELECT c_custkey, (c_acctbal < 0)::INT + (c_acctbal > 9000)::INT + (c_mktsegment NOT IN ('BUILDING', 'MACHINERY'))::INT + (c_name NOT LIKE 'Customer#%')::INT + (length(c_name) > 17)::INT + 1 AS n_errors FROM customer""")
def argument_rules(spark, sf_dir):
    rules = {
        "balance": {"type": "number", "min": 0, "max": 9000, "required": True},
        "segment": {"type": "enum", "values": ["BUILDING", "MACHINERY"]},
        "name": {"type": "pattern", "pattern": "Customer#", "max_length": 17},
        "email": {"type": "email", "required": True},
    }
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), "c_custkey")
    raw = F.to_json(F.struct(F.struct(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name")).alias("arguments")))
    out = checked(rows, raw, ArgumentGuard(rules))
    return out.select("c_custkey", F.coalesce(F.json_array_length(F.get_json_object(result("details"), "$.errors")), F.lit(0)).alias("n_errors"))


def same_country(parties: Column, law: Column, forum: Column) -> Column:
    """Ours, for the query: the law must be of a party's country."""
    return F.struct(F.array_contains(parties, F.upper(law)).alias("verified"), F.lit("Jurisdiction Mismatch").alias("message"))


@query("""SELECT c_custkey, CASE WHEN flags <> '' THEN 'error' ELSE 'warning' END AS severity, flags FROM (SELECT c_custkey, concat_ws('; ',
CASE WHEN c_custkey % 4 = 0 THEN 'Jurisdiction Mismatch' END, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'PROHIBITED_CLAUSE: Non-compete clauses are unenforceable in California.' END,
CASE WHEN c_custkey % 10 > 5 THEN 'UNREASONABLE_TERM: ' || (c_custkey % 10) || ' year term for NDA exceeds standard commercial practice (typically 2-5 years).' END) AS flags
FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def legal_contracts(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    k = F.col("c_custkey")
    contract = F.struct(
        F.lit("NDA").alias("type"),
        F.when(k % 3 == 0, "California").otherwise(F.col("n_name")).alias("jurisdiction"),
        F.array("n_name").alias("parties_countries"),
        F.when(k % 4 == 0, "ELSEWHERE").otherwise(F.upper("n_name")).alias("governing_law"),
        F.lit("court").alias("forum"),
        (k % 10).alias("term_years"),
        F.array(F.struct(F.when(k % 2 == 0, "non_compete").otherwise("termination").alias("type"))).alias("clauses"),
    )
    message = F.when(result("severity") == "error", result("message")).otherwise("")
    return checked(rows, F.to_json(contract), LegalGuard(same_country)).select("c_custkey", result("severity").alias("severity"), message.alias("flags"))


@query("SELECT l_orderkey, l_linenumber, l_partkey % 6 <> 0 AS verified FROM lineitem")
def finance_npv(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*LINE, "l_partkey", "l_extendedprice", "l_quantity")
    flows = F.array(-F.col("l_extendedprice"), F.col("l_extendedprice") / 2, F.col("l_quantity") * 100)
    npv = -F.col("l_extendedprice") + F.col("l_extendedprice") / 2 / 1.1 + F.col("l_quantity") * 100 / 1.21 + F.when(F.col("l_partkey") % 6 == 0, 1.0).otherwise(0.0)
    raw = F.to_json(F.struct(flows.alias("cashflows"), npv.alias("npv"), F.lit(0.1).alias("discount_rate")))
    return checked(rows, raw, FinanceGuard(npv_engine())).select(*LINE, "verified")


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'Missing required payroll fields: claimed_tax' WHEN event_type = 'click' AND k > 50 THEN 'LRS limit exceeded'
WHEN event_type = 'click' THEN 'TaxGuard passed' ELSE 'No tax guard for tool: ' || event_type END AS message FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def tax_routing(spark, sf_dir):
    """The engines here are stand-ins: a wire of more than 50 is over the limit."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    tool = F.when(F.col("event_type") == "view", "process_payroll").when(F.col("event_type") == "click", "send_international_wire").otherwise(F.col("event_type"))
    told = lambda ok: F.struct(ok.alias("verified"), F.lit(None).cast("string").alias("message"))
    guard = TaxGuard(payroll=lambda g, c, t: told(F.abs((g + c) * 0.0765 - t) < 1), wire=lambda a, p, y: told(a + y <= 50), crypto=lambda x, y: told(F.size(x) == 0))
    arguments = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("amount_usd"), F.lit(1).alias("gross_ytd")))
    return checked(rows, tool_call(tool, arguments), guard).select("event_id", result("message").alias("message"))


@query("SELECT 'object' AS kind, count(*) AS n FROM events UNION ALL SELECT 'text', count(*) FROM documents")
def parse_kinds(spark, sf_dir):
    from .plans.verify import parsed

    rows = table(spark, sf_dir, "events").select(F.col("props").alias("raw")).union(table(spark, sf_dir, "documents").select("text"))
    rows, r = parsed(rows)
    kind = F.when(F.coalesce(F.try_variant_get(r.value, "$.type", "string") == "text", F.lit(False)), "text").otherwise("object")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type <> 'purchase' AS verified, event_type = 'purchase' AS blocked, CASE WHEN event_type = 'purchase' THEN 'BLOCKED: Tool ''purchase'' is not allowed' END AS block_reason FROM events")
def tool_odd_json(spark, sf_dir):
    """NaN, infinities and repeated keys, which JSON readers take, hide no tool call."""
    name = json_string(F.col("event_type"))
    forms = [F.lit('"arguments":{"x":NaN}'), F.lit('"arguments":{"a":1,"a":"NaN"}'), F.lit('"arguments":[-Infinity,"a \\" NaN"]'), F.lit('"arguments":{}')]
    tail = F.element_at(F.array(*forms), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").withColumn("raw", F.concat(F.lit('{"type":"x","tool_name":"safe","type":"tool_call","tool_name":'), name, F.lit(","), tail, F.lit("}")))
    return ResponseVerifier([ToolGuard(blocked_tools=["purchase"])]).verify(rows).select("event_id", "verified", "blocked", "block_reason")


ARGUMENT_TYPES_SQL = """SELECT event_id, (event_id % 3 = 0)::INT + (event_id % 5 = 0)::INT + (event_id % 2 = 0)::INT + (event_id % 7 = 0)::INT + (event_id % 11 = 0)::INT AS n_errors FROM events"""


@query(ARGUMENT_TYPES_SQL)
def argument_types(spark, sf_dir):
    """url, uuid, boolean, integer and a further argument: each is wrong in a part of the rows."""
    e = F.col("event_id")
    url = F.when(e % 3 == 0, F.lit("ftp://x")).otherwise(F.concat(F.lit("https://example.com/"), e.cast("string")))
    uuid = F.when(e % 5 == 0, F.lit("123")).otherwise(F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(e.cast("string"), 12, "0")))
    flag = F.when(e % 2 == 0, F.lit('"yes"')).otherwise(F.lit("true"))
    number = F.when(e % 7 == 0, F.lit("1.5")).otherwise(F.lit("3"))
    more = F.when(e % 11 == 0, F.lit(',"z":1')).otherwise(F.lit(""))
    arguments = F.concat(F.lit('{"u":'), json_string(url), F.lit(',"i":'), json_string(uuid), F.lit(',"b":'), flag, F.lit(',"n":'), number, more, F.lit("}"))
    rules = {"u": {"type": "url"}, "i": {"type": "uuid"}, "b": {"type": "boolean"}, "n": {"type": "integer"}}
    rows = checked(table(spark, sf_dir, "events"), tool_call(F.lit("t"), arguments), ArgumentGuard(rules, allow_extra_args=False))
    n = F.regexp_extract(result("message"), r"(\d+) error", 1)
    return rows.select("event_id", F.when(result("passed"), 0).otherwise(F.try_to_number(n, F.lit("99")).cast("int")).alias("n_errors"))


HARM = [("password = abc", 0), ("api_key: k", 1), ("the private key", 2), ("secret=1", 3), ("private-key", 4), ("nothing here", 5)]
HARM_SQL = "SELECT event_id, event_id % 6 NOT IN (2, 5) AS blocked, CASE WHEN event_id % 6 NOT IN (2, 5) THEN 'Safety check failed: 1 critical issue(s)' END AS block_reason FROM events"


@query(HARM_SQL)
def safety_harmful(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(t) for t, _ in HARM]), (F.col("event_id") % 6 + 1).cast("int"))
    return checked(table(spark, sf_dir, "events"), content(text), SafetyGuard()).select("event_id", "blocked", "block_reason")


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 422 ELSE 200 END AS status, CASE WHEN event_type = 'purchase' THEN 'ToolGuard' ELSE '' END AS failed FROM events")
def request_tool_calls(spark, sf_dir):
    """HTTP bodies with a tool guard before all others; whatever is not verified is answered with 422."""
    from .sources.adapters import guard_tool_calls

    rows = table(spark, sf_dir, "events").select("event_id", tool_call(F.col("event_type"), F.col("props")).alias("body"))
    out = guard_tool_calls(rows, tool_guard=ToolGuard(blocked_tools=["purchase"]))
    guards = F.from_json(F.get_json_object("out_body", "$.guards"), "array<struct<guard:string,message:string>>")
    return out.select("event_id", F.col("status").cast("int").alias("status"), F.coalesce(F.array_join(guards["guard"], ","), F.lit("")).alias("failed"))


@query("SELECT doc_id, regexp_matches(text, '(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}') AS stopped FROM documents".replace("\\\\", "\\"))
def response_warnings(spark, sf_dir):
    """A response with no more than a warning is not verified, so it is stopped too."""
    from .sources.adapters import guard_bodies

    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("/a").alias("path"), content(F.col("text")).alias("body"))
    out = guard_bodies(rows, ResponseVerifier([SafetyGuard(check_injection=False, check_harmful=False, pii_allow_list=["phone", "ssn", "credit_card", "ip_address"])]), skip=["/health"])
    return out.select("doc_id", (F.get_json_object("out_body", "$.code") == "VERIFICATION_FAILED").alias("stopped")).fillna(False)


MULTI = f"""SELECT doc_id, 2 - (p <> '')::INT - (s)::INT AS guards_passed, (p <> '')::INT + s::INT AS guards_failed, s AS blocked, CASE WHEN s THEN 'Safety check failed: 1 critical issue(s)' END AS block_reason
FROM (SELECT doc_id, {pii_sql('text')} AS p, regexp_matches(text, '(?i)token\\s*[=:]\\s*\\S+') AS s FROM documents)"""


def multi(spark, sf_dir):
    secrets = SafetyGuard(check_pii=False, check_injection=False, check_harmful=False, custom_patterns=[r"(?i)token\s*[=:]\s*\S+"])
    return checked(table(spark, sf_dir, "documents").select("doc_id", "text"), content(F.col("text")), SafetyGuard(check_injection=False, check_harmful=False), secrets)


@query(MULTI)
def verify_multi_guard(spark, sf_dir):
    return multi(spark, sf_dir).select("doc_id", "guards_passed", "guards_failed", "blocked", "block_reason")


@query(f"SELECT count(*) AS total, count(*) FILTER (guards_failed = 0) AS passed, count(*) FILTER (guards_failed > 0) AS failed, count(*) FILTER (guards_failed = 0) / count(*)::DOUBLE AS success_rate FROM ({MULTI})")
def verification_summary(spark, sf_dir):
    return summary(multi(spark, sf_dir))


def stream_items(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    call = F.concat(F.lit('{"type":"tool_call","tool_call":{"name":"'), "event_type", F.lit('","arguments":'), "props", F.lit("}}"))
    return rows.select("event_id", F.when(F.col("event_type") == "view", F.lit('{"type":"text","content":"view"}')).otherwise(call).alias("item"))


STREAM = "SELECT event_id, CASE WHEN event_type = 'view' THEN 'passed' WHEN event_type = 'error' THEN 'blocked' ELSE 'verified' END AS outcome, CASE WHEN event_type = 'error' THEN 'BLOCKED: Tool ''error'' is not allowed' END AS block_reason FROM events"


@query(STREAM)
def stream_verify(spark, sf_dir):
    return verify_stream(stream_items(spark, sf_dir), ResponseVerifier([ToolGuard(blocked_tools=["error"])])).select("event_id", "outcome", "block_reason")


@query(f"SELECT count(*) AS total, count(*) FILTER (outcome = 'verified') AS verified, count(*) FILTER (outcome = 'blocked') AS blocked FROM ({STREAM})")
def stream_statistics(spark, sf_dir):
    return stream_stats(verify_stream(stream_items(spark, sf_dir), ResponseVerifier([ToolGuard(blocked_tools=["error"])])))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in REGISTERED.items() if sql}
