"""A refused or masked column is not read."""
import hashlib

import pytest
from pyspark.sql import functions as F

from meshwork.operators import governance as E
from meshwork.operators.governed import AccessRefused, governed_read, read_or_none

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def customer(spark):
    return spark.read.parquet(f"{SF}/customer.parquet")


@pytest.fixture(scope="module")
def policies(spark, customer):
    return E.access_policies(E.columns_table(spark, {"customer": customer}))


def scan(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("ReadSchema: "):].split("\n")[0]


def test_hidden_columns_are_not_in_the_scan(customer, policies):
    for way in ("drop", "null", "constant"):
        assert "c_name" not in scan(governed_read(customer, "customer", "analyst", policies, restricted=way))
    assert "c_name" in scan(governed_read(customer, "customer", "analyst", policies, restricted="hash"))
    assert "c_name" in scan(governed_read(customer, "customer", "manager", policies))
    one = governed_read(customer, "customer", "analyst", policies, ["c_custkey"])
    assert scan(one) == "ReadSchema: struct<c_custkey:bigint>"


def test_refusals_come_before_the_data(spark, customer, policies):
    lost = spark.createDataFrame([(1, "n")], "c_custkey int, c_name string").where(F.raise_error(F.lit("read")).isNull())
    with pytest.raises(AccessRefused, match="restricted"):
        governed_read(lost, "customer", "analyst", policies)
    with pytest.raises(AccessRefused, match="guest"):
        governed_read(lost, "customer", "guest", policies, restricted="hash")
    assert read_or_none(lost, "customer", "guest", policies, restricted="drop") is None
    with pytest.raises(ValueError, match="absent"):
        governed_read(customer, "customer", "manager", policies, ["absent"])
    with pytest.raises(ValueError, match="blur"):
        governed_read(customer, "customer", "analyst", policies, restricted="blur")
    assert governed_read(customer, "no policy", "guest", policies).columns == customer.columns


def test_masks_and_what_lies_behind_them(spark, policies):
    df = spark.createDataFrame([(1, "Ann Smith"), (2, "Bo"), (3, None), (4, "")], "c_custkey int, c_name string")

    def names(way, salt=""):
        out = governed_read(df, "customer", "analyst", policies, restricted=way, salt=salt)
        assert out.columns == ["c_custkey", "c_name"]
        return [r.c_name for r in out.orderBy("c_custkey").collect()]
    assert names("last4") == ["***mith", "***", None, "***"]
    assert names("initial") == ["A***", "B***", None, "***"]
    assert names("constant") == ["***"] * 4 and names("null") == [None] * 4
    assert names({"*": "null", "c_name": "hash"}, "s")[0] == hashlib.sha256(b"sAnn Smith").hexdigest()
    masked = governed_read(df, "customer", "analyst", policies, restricted="initial")
    assert masked.where("c_name = 'Ann Smith'").count() == 0 and masked.where("c_name like 'A%'").count() == 1
