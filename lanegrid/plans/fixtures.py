"""Master, claims and rates derived from the test tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegrid.plans import dims
from lanegrid.runtime import table


def _zone(zid):
    return F.element_at(F.array(*map(F.lit, dims.ZONES)), zid + 1)


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pincode, zone, city, state, c_custkey, zid): blocks of ten consecutive pincodes per zone."""
    block = F.floor(F.col("c_custkey") / 10).cast("long")
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    zid = (block % 20).cast("int")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        (100000 + (block * 7919 % 8999) * 100 + F.col("c_custkey") % 10).cast("int").alias("pincode"),
        _zone(zid).alias("zone"),
        F.col("c_mktsegment").alias("city"),
        F.col("n_name").alias("state"),
        "c_custkey",
        "c_acctbal",
        zid.alias("zid"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vendor_id, pincode, claimed_zone, canon_zone, oda, city, state) of four vendors."""
    rows = master(spark, sf_dir).withColumn("vendor_id", F.explode(F.array(*[F.lit(v) for v in range(4)])))
    part = (F.col("zid") + F.col("vendor_id")) % 5
    rows = rows.where((part == 1) | ((part != 0) & ((F.col("c_custkey") * 7 + F.col("vendor_id")) % 10 < 7)))
    claimed = F.when((F.col("vendor_id") == 3) & (F.col("c_custkey") % 29 == 3), (F.col("zid") + 1) % 20).otherwise(F.col("zid"))
    return rows.select(
        "vendor_id",
        F.when(F.col("c_custkey") % 97 == 5, 999999 - F.col("c_custkey")).otherwise(F.col("pincode")).cast("int").alias("pincode"),
        _zone(claimed).alias("claimed_zone"),
        F.col("zone").alias("canon_zone"),
        (F.col("c_acctbal") < 0).alias("oda"),
        "city",
        "state",
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vendor_id, origin, dest, rate, seq): rate samples in steps of 0.25, in order of seq."""
    t = lambda n: table(spark, sf_dir, n)
    # orders and suppliers are joined with their small tables first, and of a line only what the rate needs is shuffled
    m = master(spark, sf_dir).select("c_custkey", "zid")
    placed = t("orders").join(m, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("zid").cast("byte").alias("zid"))
    sold = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sold = sold.select("s_suppkey", (F.col("s_suppkey") % 4).cast("byte").alias("vendor"), (F.col("n_nationkey") % 20).cast("byte").alias("o"))
    lines = t("lineitem").join(sold, F.col("l_suppkey") == F.col("s_suppkey"))
    # the remainders by 1 to 9 are those of the remainder by their common multiple
    lines = lines.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 2520).cast("short").alias("part"), "vendor", "o")
    joined = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    o, zid = F.col("o").cast("int"), F.col("zid").cast("int")
    rate = 5 + o * 0.5 + zid * 0.25 + F.col("part").cast("long") % (1 + zid % 9)
    return joined.select(
        F.col("vendor").cast("int").alias("vendor_id"),
        _zone(o).alias("origin"),
        _zone(zid).alias("dest"),
        rate.cast("double").alias("rate"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


_LIST = "[" + ", ".join(f"'{z}'" for z in dims.ZONES) + "]"

SQL = {
    **dims.SQL,
    "master": f"""SELECT CAST(100000 + (CAST(floor(c_custkey / 10) AS BIGINT) * 7919 % 8999) * 100 + c_custkey % 10 AS INT) AS pincode,
        {_LIST}[CAST(floor(c_custkey / 10) AS BIGINT) % 20 + 1] AS zone, c_mktsegment AS city, n_name AS state, c_custkey, c_acctbal,
        CAST(CAST(floor(c_custkey / 10) AS BIGINT) % 20 AS INT) AS zid FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "claims": f"""SELECT v.vendor_id, CAST(CASE WHEN c_custkey % 97 = 5 THEN 999999 - c_custkey ELSE pincode END AS INT) AS pincode,
        {_LIST}[(CASE WHEN v.vendor_id = 3 AND c_custkey % 29 = 3 THEN (zid + 1) % 20 ELSE zid END) + 1] AS claimed_zone,
        zone AS canon_zone, c_acctbal < 0 AS oda, city, state
        FROM master CROSS JOIN (VALUES (0), (1), (2), (3)) v(vendor_id)
        WHERE (zid + v.vendor_id) % 5 = 1 OR ((zid + v.vendor_id) % 5 <> 0 AND (c_custkey * 7 + v.vendor_id) % 10 < 7)""",
    "rates": f"""SELECT CAST(s_suppkey % 4 AS INT) AS vendor_id, {_LIST}[n_nationkey % 20 + 1] AS origin, zone AS dest,
        CAST(5 + (n_nationkey % 20) * 0.5::DOUBLE + zid * 0.25::DOUBLE + (l_partkey % (1 + zid % 9)) AS DOUBLE) AS rate, l_orderkey * 10 + l_linenumber AS seq
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN orders ON l_orderkey = o_orderkey JOIN master ON o_custkey = c_custkey""",
}


def _rounded(text: str) -> str:
    """Replaces ``round2(x)`` by the library's rounding to two digits."""
    while (at := text.rfind("round2(")) >= 0:
        start = end = at + len("round2(")
        depth = 1
        while depth:
            depth += (text[end] == "(") - (text[end] == ")")
            end += 1
        text = f"{text[:at]}(floor(({text[start : end - 1]}) * 100 + 0.500001::DOUBLE) / 100){text[end:]}"
    return text


def sql(body: str, **more: str) -> str:
    """``body`` over the views; ``more`` adds further ones."""
    return _rounded("WITH " + ",\n".join(f"{name} AS ({text})" for name, text in {**SQL, **more}.items()) + "\n" + body)
