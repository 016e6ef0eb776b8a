"""Origin-destination rates: resolving conflicting samples, checks, gap filling by distance, quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegrid.plans import dims

CELL = ["vendor_id", "origin", "dest"]

# Economic weights and coordinates of the rough rate estimate.
ESTIMATE = {
    "N1": (28.7, 77.1, 1.2), "N2": (28.6, 77.2, 1.3), "N3": (28.5, 77.0, 1.1), "N4": (28.4, 77.3, 1.2),
    "S1": (13.1, 80.3, 1.1), "S2": (12.9, 80.2, 1.0), "S3": (17.4, 78.5, 1.0), "S4": (19.1, 72.9, 1.3),
    "E1": (22.6, 88.4, 1.0), "E2": (26.1, 91.7, 0.8), "W1": (19.1, 72.9, 1.3), "W2": (18.5, 73.9, 1.1),
    "C1": (23.3, 77.4, 0.9), "C2": (21.1, 79.1, 0.8), "NE1": (26.1, 91.7, 0.7), "NE2": (27.5, 94.1, 0.6), "X1": (11.6, 92.7, 0.5),
}


def money(x: Column) -> Column:
    """Two digits, halves up, with a tolerance of a millionth of the last digit: a half that is not exact in binary goes up too."""
    return F.floor(x * 100 + 0.500001) / 100


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * dims.EARTH_KM * F.asin(F.sqrt(h))


def zone_distances(spark) -> DataFrame:
    """(a, b, km) between all zones that have coordinates: 361 rows."""
    c = dims.coordinates(spark)
    a, b = c.toDF("a", "lat1", "lon1"), c.toDF("b", "lat2", "lon2")
    return F.broadcast(a.join(b, how="cross").select("a", "b", haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("km")))


def pick_rate(samples: DataFrame, threshold: float, inclusive: bool) -> DataFrame:
    """One rate per cell: the highest sample if they are close, else their mean, to two digits."""
    spread = F.max("rate") - F.min("rate")
    close = spread <= threshold if inclusive else spread < threshold
    return samples.groupBy(*CELL).agg(money(F.when(close, F.max("rate")).otherwise(F.avg("rate"))).alias("rate"))


def median_rate(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*CELL).agg(money(F.median("rate")).alias("rate"))


def rate_mode(matrix: DataFrame) -> DataFrame:
    """Per vendor: road, effective, mixed or air by the range of its rates."""
    low, high = F.col("min_rate"), F.col("max_rate")
    mode = F.when(low > 60, "air").when(low > 30, "effective").when(high > 200, "mixed").otherwise("road")
    found = matrix.where("rate > 0").groupBy("vendor_id").agg(
        money(F.min("rate")).alias("min_rate"), money(F.max("rate")).alias("max_rate"), money(F.avg("rate")).alias("avg_rate")
    )
    vendors = matrix.select("vendor_id").distinct().join(found, "vendor_id", "left")
    return vendors.withColumn("mode", F.when(low.isNull(), "unknown").otherwise(mode))


def collapsed(matrix: DataFrame, least: int = 3) -> DataFrame:
    """Destinations where at least ``least`` origins all have one positive rate."""
    rows = matrix.where("rate > 0").groupBy("vendor_id", "dest").agg(F.count("*").alias("origins"), F.count_distinct("rate").alias("rates"), F.max("rate").alias("rate"))
    return rows.where((F.col("origins") >= least) & (F.col("rates") == 1)).select("vendor_id", "dest", "origins", "rate")


def misaligned(matrix: DataFrame, least: int = 2) -> DataFrame:
    """Origins with at least ``least`` cross rates equal to the rate within the zone."""
    own = F.max(F.when(F.col("origin") == F.col("dest"), F.col("rate"))).over(Window.partitionBy("vendor_id", "origin"))
    same = matrix.withColumn("own", own).where("origin <> dest and rate = own")
    return same.groupBy("vendor_id", "origin").agg(F.count("*").alias("same"), F.max("own").alias("rate")).where(F.col("same") >= least)


def drop_air(matrix: DataFrame, limit: float = 60.0) -> DataFrame:
    """Drops origins whose lowest rate is above ``limit``, unless all of a vendor's are."""
    low = F.min("rate").over(Window.partitionBy("vendor_id", "origin"))
    rows = matrix.withColumn("_air", low > limit)
    every = F.min(F.col("_air").cast("int")).over(Window.partitionBy("vendor_id")) == 1
    return rows.withColumn("_all", every).where(~F.col("_air") | F.col("_all")).drop("_air", "_all")


def fullest_matrix(pieces: DataFrame) -> DataFrame:
    """Of the matrices (vendor_id, piece, origin, dest, rate) of a vendor the one with most cells; the first of equals."""
    counted = pieces.withColumn("_n", F.count("*").over(Window.partitionBy("vendor_id", "piece")))
    first = F.dense_rank().over(Window.partitionBy("vendor_id").orderBy(F.desc("_n"), "piece"))
    return counted.withColumn("_rank", first).where("_rank = 1").drop("_n", "_rank")


def canonical_matrix(raw: DataFrame) -> DataFrame:
    """(vendor_id, origin, dest, rate, high): cells of known zones with positive rates; later rows (seq) overwrite."""
    rows = raw.where((F.col("rate") > 0) & F.col("origin").isin(dims.ZONES) & F.col("dest").isin(dims.ZONES))
    return rows.groupBy(*CELL).agg(F.max_by("rate", F.struct("seq", "rate")).alias("rate")).withColumn("high", F.col("rate") > 1000)


def matrix_issues(raw: DataFrame) -> DataFrame:
    """Rows of a raw matrix that ``canonical_matrix`` leaves out or marks, by kind."""
    issue = (
        F.when(~F.col("origin").isin(dims.ZONES), "unknown_origin").when(~F.col("dest").isin(dims.ZONES), "unknown_dest").when(F.col("rate") <= 0, "non_positive").when(F.col("rate") > 1000, "very_high")
    )
    return raw.withColumn("issue", issue).where("issue is not null")


def symmetric_fill(matrix: DataFrame) -> DataFrame:
    """Adds the reverse of every cell that has none; added cells are estimates."""
    reverse = matrix.select("vendor_id", F.col("dest").alias("origin"), F.col("origin").alias("dest"), "rate").join(matrix, CELL, "left_anti")
    return matrix.select(*CELL, "rate").withColumn("estimated", F.lit(False)).unionByName(reverse.withColumn("estimated", F.lit(True)))


def _damped(far: Column, near: Column) -> Column:
    return F.when(near > 1, F.least(F.lit(2.5), F.greatest(F.lit(0.5), 0.65 + 0.35 * far / near))).otherwise(1.0)


def nearest_origins(matrix: DataFrame, k: int = 3) -> DataFrame:
    """(vendor_id, missing, known, km): the ``k`` nearest known origins of every origin a vendor has no rates for."""
    spark = matrix.sparkSession
    known = matrix.select("vendor_id", F.col("origin").alias("known")).distinct()
    every = known.select("vendor_id").distinct().join(F.broadcast(dims.coordinates(spark).select(F.col("zone").alias("missing"))), how="cross")
    missing = every.join(known, [every["vendor_id"] == known["vendor_id"], every["missing"] == known["known"]], "left_anti")
    pairs = missing.join(known, "vendor_id").join(zone_distances(spark), (F.col("a") == F.col("missing")) & (F.col("b") == F.col("known")))
    rank = F.row_number().over(Window.partitionBy("vendor_id", "missing").orderBy("km", "known"))
    return pairs.withColumn("place", rank).where(F.col("place") <= k).select("vendor_id", "missing", "known", "km", "place")


def fill_missing_origins(matrix: DataFrame) -> DataFrame:
    """Rates of missing origins by distance-weighted means over the three nearest known ones; all are estimates."""
    dist = zone_distances(matrix.sparkSession)
    near = nearest_origins(matrix).join(matrix.withColumnRenamed("origin", "known"), ["vendor_id", "known"])
    near = near.join(dist.toDF("missing", "dest", "km_missing"), ["missing", "dest"]).join(dist.toDF("known", "dest", "km_known"), ["known", "dest"])
    weight = 1 / (F.col("km") + 1)
    scaled = F.col("rate") * _damped(F.col("km_missing"), F.col("km_known"))
    rate = money(F.sum(scaled * weight) / F.sum(weight))
    return near.groupBy("vendor_id", F.col("missing").alias("origin"), "dest").agg(rate.alias("rate")).withColumn("estimated", F.lit(True))


def fill_dest_gaps(matrix: DataFrame) -> DataFrame:
    """Rates of missing destinations of each origin, from the known one at the most similar distance.

    References are quoted rates only (filled ones do not become references), and special zones
    are no reference for regular ones.
    """
    spark = matrix.sparkSession
    rows = matrix.where("rate > 0").withColumn("special", F.col("dest").startswith("X"))
    key = ["vendor_id", "origin"]
    bounds = rows.groupBy(*key).agg(
        F.coalesce(F.min(F.when(~F.col("special"), F.col("rate"))), F.min("rate")).alias("lo"),
        F.coalesce(F.max(F.when(~F.col("special"), F.col("rate"))), F.max("rate")).alias("hi"),
        F.max("rate").alias("top"),
    )
    dist = zone_distances(spark)
    missing = bounds.join(dist.toDF("origin", "to", "km"), "origin").join(matrix.select(*key, F.col("dest").alias("to")), [*key, "to"], "left_anti")
    known = rows.join(dist.toDF("origin", "dest", "km_ref"), ["origin", "dest"]).select(*key, "dest", "rate", "km_ref", "special")
    pairs = missing.join(known, key).where(F.col("to").startswith("X") | ~F.col("special"))
    best = pairs.groupBy(*key, "to", "lo", "hi", "top", "km").agg(F.min_by(F.struct("rate", "km_ref"), F.struct(F.abs(F.col("km_ref") - F.col("km")).alias("gap"), "dest")).alias("ref"))
    cap = F.when(F.col("to").startswith("X"), F.greatest(F.col("hi") * 2, F.col("top"))).otherwise(F.col("hi"))
    scaled = F.greatest(F.col("lo"), F.least(cap, F.col("ref.rate") * (0.7 + 0.3 * F.col("km") / F.col("ref.km_ref"))))
    rate = money(F.when(F.col("ref.km_ref") > 0, scaled).otherwise(F.col("ref.rate")))
    return best.select(*key, F.col("to").alias("dest"), rate.alias("rate")).withColumn("estimated", F.lit(True))


def extrapolate(matrix: DataFrame, base: DataFrame) -> DataFrame:
    """A full matrix from one origin per vendor (``base``: vendor_id, origin), gaps of which are filled first."""
    spark = matrix.sparkSession
    one = matrix.join(base, ["vendor_id", "origin"]).select(*CELL, "rate")
    full = one.unionByName(fill_dest_gaps(one).drop("estimated"))
    limits = full.where("rate > 0").groupBy("vendor_id").agg(F.min("rate").alias("lo"), F.max("rate").alias("hi"))
    dist = zone_distances(spark)
    cells = full.join(dist.toDF("origin", "dest", "km_base"), ["origin", "dest"]).join(dist.toDF("from", "dest", "km_from"), "dest").where("from <> origin").join(limits, "vendor_id")
    scaled = money(F.col("rate") * _damped(F.col("km_from"), F.col("km_base")))
    rate = F.when(F.col("km_base") < 1, money(F.col("rate"))).otherwise(money(F.greatest(F.col("lo") * 0.8, F.least(F.col("hi") * 2.5, scaled))))
    return cells.select("vendor_id", F.col("from").alias("origin"), "dest", rate.alias("rate")).withColumn("estimated", F.lit(True))


def estimate(lanes: DataFrame, base: float = 8.0) -> DataFrame:
    """Adds ``rate``: a rough estimate by distance and economic weight; twice the base for unknown zones."""
    spark = lanes.sparkSession
    known = spark.createDataFrame([(z, *v) for z, v in ESTIMATE.items()], "zone string, lat double, lon double, weight double").coalesce(1)
    side = lambda n: F.broadcast(known.toDF("origin" if n == 1 else "dest", f"lat{n}", f"lon{n}", f"w{n}"))
    rows = lanes.join(side(1), "origin", "left").join(side(2), "dest", "left")
    km = haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    factor = F.when(F.col("origin") == F.col("dest"), 1.0).otherwise(1 + km / 500)
    rate = F.coalesce(F.round(base * factor * (F.col("w1") + F.col("w2")) / 2, 1), F.lit(2 * base))
    return rows.select(*lanes.columns, rate.alias("rate")).withColumn("estimated", F.lit(True))


def quotes(lanes: DataFrame, matrix: DataFrame, master: DataFrame) -> DataFrame:
    """Charges of (vendor_id, from_pin, to_pin, weight): base, 30 % fuel, 18 % GST; unknown zones and lanes get a status."""
    side = lambda p, z: master.select(F.col("pincode").alias(p), F.col("zone").alias(z))
    rows = lanes.join(side("from_pin", "origin"), "from_pin", "left").join(side("to_pin", "dest"), "to_pin", "left").join(matrix.select(*CELL, "rate"), CELL, "left")
    base = F.col("rate") * F.col("weight")
    status = F.when(F.col("origin").isNull() | F.col("dest").isNull(), "unknown_zone").when(F.col("rate").isNull(), "no_rate").otherwise("ok")
    return rows.select(
        *lanes.columns,
        "origin",
        "dest",
        status.alias("status"),
        money(base).alias("base"),
        money(base * 0.3).alias("fuel"),
        money(base * 1.3 * 0.18).alias("gst"),
        money(base * 1.3 * 1.18).alias("total"),
    )


def missing_lanes(matrix: DataFrame, active: DataFrame) -> DataFrame:
    """Pairs of active zones (vendor_id, zone) without a rate, among origins that have rates: at most 400 a vendor."""
    origins = matrix.select("vendor_id", "origin").distinct().join(active.withColumnRenamed("zone", "origin"), ["vendor_id", "origin"])
    pairs = origins.join(active.withColumnRenamed("zone", "dest"), "vendor_id")
    return pairs.join(matrix.select(*CELL), CELL, "left_anti")
