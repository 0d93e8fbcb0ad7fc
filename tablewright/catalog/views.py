"""Deterministic dirty versions of the clean test tables.

Each view is a list of (name, SQL expression) over a base table, written in
the part of SQL that Spark and DuckDB share, so both sides derive the same
defects from the same whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_YEAR = "lpad(CAST(year(o_orderdate) AS STRING), 4, '0')"
_MONTH = "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')"
_DAY = "lpad(CAST(day(o_orderdate) AS STRING), 2, '0')"
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_MONEY = (f"concat('$', CAST(CAST(floor({_CENTS} / 100000) AS BIGINT) AS STRING), ',', "
          f"lpad(CAST(CAST(floor(({_CENTS} % 100000) / 100) AS BIGINT) AS STRING), 3, '0'), '.', "
          f"lpad(CAST({_CENTS} % 100 AS STRING), 2, '0'))")

VIEWS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "dirty_customer": ("customer", [
        ("c_custkey", "c_custkey"), ("c_nationkey", "c_nationkey"), ("c_acctbal", "c_acctbal"),
        ("c_mktsegment", "CASE c_custkey % 10 WHEN 0 THEN 'N/A' WHEN 1 THEN '' WHEN 2 THEN '  ' "
                         "WHEN 3 THEN lower(c_mktsegment) WHEN 4 THEN NULL ELSE c_mktsegment END"),
        ("contact_email", "CASE WHEN c_custkey % 7 = 0 THEN concat('user', CAST(c_custkey AS STRING), '@site') "
                          "WHEN c_custkey % 7 = 1 THEN NULL "
                          "ELSE concat('user', CAST(c_custkey AS STRING), '@mail.example.com') END"),
        ("contact_phone", "CASE WHEN c_custkey % 6 = 0 THEN 'call me' ELSE concat('555-', "
                          "lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-', "
                          "lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) END"),
        ("cust_age", "CAST((c_custkey * 37) % 200 - 20 AS BIGINT)"),
    ]),
    "mixed_events": ("events", [
        ("event_id", "event_id"),
        ("payload", "CASE event_id % 7 WHEN 0 THEN concat('{\"k\": ', CAST(user_id AS STRING), '}') WHEN 1 THEN concat('{\"k\": \"', event_type, '\", \"other\": 1}') "
                    "WHEN 2 THEN concat('{\"k\": {\"n\": ', CAST(user_id AS STRING), '}}') WHEN 3 THEN '{\"k\": null}' "
                    "WHEN 4 THEN '{\"k\": [1, 2], \"other\": true}' WHEN 5 THEN '{\"k\": 2.5}' ELSE 'not JSON' END"),
    ]),
    "money_orders": ("orders", [
        ("o_orderkey", "o_orderkey"),
        ("amount", f"CASE WHEN o_orderkey % 3 = 0 THEN {_MONEY} ELSE CAST(o_totalprice AS STRING) END"),
    ]),
    "dirty_orders": ("orders", [
        ("o_orderkey", "o_orderkey"),
        ("order_date", f"CASE o_orderkey % 4 WHEN 0 THEN concat({_YEAR}, '-', {_MONTH}, '-', {_DAY}) "
                       f"WHEN 1 THEN concat({_MONTH}, '/', {_DAY}, '/', {_YEAR}) "
                       f"WHEN 2 THEN concat({_MONTH}, '-', {_DAY}, '-', {_YEAR}) ELSE 'not yet' END"),
        ("amount", f"CASE o_orderkey % 3 WHEN 0 THEN {_MONEY} WHEN 1 THEN CAST(o_totalprice AS STRING) "
                   "ELSE 'not disclosed' END"),
        ("o_orderpriority", "CASE WHEN o_orderkey % 5 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END"),
    ]),
    "sparse_events": ("events", [
        ("event_id", "event_id"),
        ("event_type", "event_type"),
        ("value", "CASE WHEN event_id % 20 <> 0 THEN value END"),
        ("value2", "CASE WHEN event_id % 3 <> 0 THEN value END"),
        ("value3", "CASE WHEN event_id % 3 = 0 THEN value END"),
        ("value4", "CASE WHEN event_id % 50 <> 0 THEN value END"),
        ("seen_at", "CASE WHEN event_id % 4 <> 0 THEN ts END"),
    ]),
    "near_part": ("part", [
        ("p_partkey", "p_partkey"),
        ("p_name", "CASE p_partkey % 5 "
                   "WHEN 0 THEN concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1)) "
                   "WHEN 1 THEN concat(substring(p_name, 1, CAST(p_partkey % length(p_name) AS INT)), "
                   "substring(p_name, CAST(p_partkey % length(p_name) + 2 AS INT))) "
                   "WHEN 2 THEN upper(p_name) ELSE p_name END"),
    ]),
    "messy_names": ("part", [
        ("Part Key", "p_partkey"), ("p-name", "concat(p_name, ' o''neil 3rd co-op')"), ("p.name", "p_name"),
        (" Brand ", "CASE WHEN p_partkey % 400 = 1 THEN 'other' ELSE 'same' END"),
        ("Half  Full", "CASE WHEN p_partkey % 100 = 1 THEN 'other' ELSE 'same' END"),
        ("nothing", "CAST(NULL AS STRING)"), ("size", "CAST(p_size AS DOUBLE)"), ("p_retailprice", "p_retailprice"),
    ]),
    "births": ("orders", [
        ("o_orderkey", "o_orderkey"),
        ("birth_date", f"concat({_YEAR}, '-', {_MONTH}, '-', {_DAY})"),
    ]),
}

# Copies of every fiftieth order; the copies follow the originals in row order.
DUP_COLUMNS = {"dup_lineitem": ("lineitem", "l_orderkey"), "dup_orders": ("orders", "o_orderkey")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = VIEWS[name]
    df = table(spark, sf_dir, base)
    return df.select(*[F.expr(e).alias(n) for n, e in columns])


def duplicated(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, key = DUP_COLUMNS[name]
    df = table(spark, sf_dir, base)
    return df.unionByName(df.filter(f"{key} % 50 = 0"))


def duplicated_with_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return (df.withColumn("_row_id", F.expr("2 * o_orderkey"))
            .unionByName(df.filter("o_orderkey % 50 = 0").withColumn("_row_id", F.expr("2 * o_orderkey + 1"))))


def view_sql(name: str) -> str:
    """The same view as a DuckDB subquery."""
    if name in DUP_COLUMNS:
        base, key = DUP_COLUMNS[name]
        return f"(SELECT * FROM {base} UNION ALL SELECT * FROM {base} WHERE {key} % 50 = 0)"
    base, columns = VIEWS[name]
    body = ", ".join(f'{e} AS "{n}"' for n, e in columns)
    return f"(SELECT {body} FROM {base})"
