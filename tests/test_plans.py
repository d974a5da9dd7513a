"""Work per row: how often an optimized plan reads a JSON value, and whether one file's rows are shared out."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


#: query: most reads of a value (each of these had 58 or more when branches and messages repeated what they read)
READS = {"argument_rules": 60, "argument_types": 60, "legal_contracts": 60, "state_orders": 60, "schema_props": 60, "math_custom": 45, "finance_npv": 45}


@pytest.mark.parametrize("name", READS)
def test_values_are_read_once(spark, name):
    assert plan(spark, name).count("variant_get") <= READS[name]


@pytest.mark.parametrize("name", ["argument_rules", "legal_contracts"])
def test_rows_are_shared_out(spark, name):
    assert "RepartitionByExpression" in plan(spark, name)


def test_addresses_are_searched_apart(spark):
    from pyspark.sql import functions as F

    from verdikt.operators.safety import PII_PATTERNS, found_in

    texts = ["a@b.org", "a b", "@", "1.2.3.4", "x@y.com 123-45-6789", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", found_in(F.col("t"), PII_PATTERNS).alias("f"))
    assert "contains(t" in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r.f for r in got.orderBy("k").collect()] == [["email"], [], [], ["ip_address"], ["email", "ssn"], []]
