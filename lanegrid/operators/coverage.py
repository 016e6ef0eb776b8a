"""Coverage of pincodes by zone: look-ups, validation, range compression and serviceability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegrid.functions.pincodes import expand_ranges
from lanegrid.plans import dims

FULL_SHARE = 0.999


def unique_master(master: DataFrame) -> DataFrame:
    """The master dimension with upper-cased names; of repeated pincodes the last row (by c_custkey) counts."""
    rows = master.where(F.col("pincode").between(100000, 999999))
    last = rows.groupBy("pincode").agg(F.max_by(F.struct("zone", "city", "state"), "c_custkey").alias("m"))
    return last.select("pincode", *[F.upper(F.trim(f"m.{c}")).alias(c) for c in ("zone", "city", "state")])


def with_zone(pins: DataFrame, master: DataFrame) -> DataFrame:
    """Adds ``zone`` (null if unknown) and ``state`` of the master."""
    return pins.join(master.select("pincode", "zone", "state"), "pincode", "left")


def prefix_lists(pins: DataFrame) -> DataFrame:
    """Adds the zones that the first digit (``zones1``) and the first two (``zones2``) can mean."""
    known = dims.prefix_zones(pins.sparkSession)
    text = F.col("pincode").cast("string")
    for n in (1, 2):
        side = F.broadcast(known.where(F.length("prefix") == n).select(F.col("prefix").alias(f"_p{n}"), F.col("zones").alias(f"zones{n}")))
        pins = pins.join(side, F.substring(text, 1, n) == F.col(f"_p{n}"), "left").drop(f"_p{n}")
    return pins


def check_zone(pins: DataFrame, master: DataFrame, zone: str = "claimed_zone") -> DataFrame:
    """Adds ``ok`` and ``reason`` for the zone a pincode is claimed for.

    In order: format, known zone, exact master entry, first digit, first two digits; what passes
    without a master entry passes with a warning.
    """
    rows = prefix_lists(with_zone(pins.withColumnRenamed("state", "_state") if "state" in pins.columns else pins, master))
    claimed = F.col(zone)
    reason = (
        F.when(~F.col("pincode").between(100000, 999999), "format")
        .when(~claimed.isin(dims.ZONES), "unknown_zone")
        .when(F.col("zone") == claimed, "exact")
        .when(F.col("zone").isNotNull(), "mismatch")
        .when(F.col("zones1").isNotNull() & ~F.array_contains("zones1", claimed), "impossible_prefix1")
        .when(F.col("zones2").isNotNull() & ~F.array_contains("zones2", claimed), "impossible_prefix2")
        .otherwise("not_in_master")
    )
    return rows.withColumn("reason", reason).withColumn("ok", F.col("reason").isin("exact", "not_in_master"))


def zone_validation(checked: DataFrame) -> DataFrame:
    """Status per checked pincode; a master mismatch stays valid, with a warning."""
    status = F.when(F.col("reason") == "exact", "valid").when(F.col("reason") == "mismatch", "database_mismatch").when(F.col("ok"), "warning").otherwise("invalid")
    return checked.withColumns({"status": status, "kept": F.col("ok") | (F.col("reason") == "mismatch")})


def drop_impossible(checked: DataFrame, strict: bool = False) -> DataFrame:
    """Keeps exact matches, then what the first digit allows; ``strict`` also drops other zones in the master."""
    allowed = F.col("zones1").isNull() | F.array_contains("zones1", F.col("claimed_zone"))
    keep = (F.col("zone") == F.col("claimed_zone")) | allowed
    if strict:
        keep = (F.col("zone") == F.col("claimed_zone")) | (F.col("zone").isNull() & allowed)
    return checked.where(F.coalesce(keep, allowed))


def likely_zones(pins: DataFrame, master: DataFrame) -> DataFrame:
    """Adds ``zones``: exact, else by two digits, else by one, else all."""
    rows = prefix_lists(with_zone(pins, master))
    every = F.array(*map(F.lit, dims.ZONES))
    return rows.withColumn("zones", F.coalesce(F.when(F.col("zone").isNotNull(), F.array("zone")), "zones2", "zones1", every))


def resolve_flat(pins: DataFrame, master: DataFrame) -> DataFrame:
    """Adds ``resolved``: the likely zone if there is only one."""
    return likely_zones(pins, master).withColumn("resolved", F.when(F.size("zones") == 1, F.get("zones", F.lit(0))))


def expand_label(label: Column) -> Column:
    """Parts of a zone label to look up: the whole, or its pieces at ``/`` and ``+``."""
    clean = F.upper(F.trim(F.regexp_replace(label, "[-_]", " ")))
    return F.transform(F.split(clean, r"\s*[/+]\s*"), lambda p: F.trim(p))


def label_zones(rows: DataFrame, label: str) -> DataFrame:
    """Adds ``zones``: of the label itself, else the union of its parts in order, else of its first word."""
    table = {**dims.LABEL_ZONES, **{z: [z] for z in dims.ZONES}}
    look = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    whole = F.upper(F.trim(F.col(label)))
    clean = F.upper(F.trim(F.regexp_replace(F.col(label), "[-_]", " ")))
    union = F.array_distinct(F.flatten(F.filter(F.transform(expand_label(F.col(label)), lambda p: look[p]), lambda z: z.isNotNull())))
    first = look[F.get(F.split(clean, " "), F.lit(0))]
    return rows.withColumn("zones", F.coalesce(look[whole], look[clean], F.when(F.size(union) > 0, union), first))


def zone_overrides(resolved: DataFrame, order: str) -> DataFrame:
    """(vendor_id, pincode, zone): pins priced in another zone than their own; the later label wins."""
    other = resolved.where(F.col("resolved").isNotNull() & F.col("zone").isNotNull() & (F.col("resolved") != F.col("zone")))
    return other.groupBy("vendor_id", "pincode").agg(F.max_by("resolved", order).alias("zone"))


def islands(pins: DataFrame, by: list[str], pincode: str = "pincode") -> DataFrame:
    """(by, lo, hi, n): maximal runs of consecutive pincodes; ``pins`` has no repeats."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(pincode))
    runs = pins.withColumn("_run", F.col(pincode) - rank).groupBy(*by, "_run")
    return runs.agg(F.min(pincode).alias("lo"), F.max(pincode).alias("hi"), F.count("*").alias("n")).drop("_run")


def compress_ranges(pins: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """(by, ranges array<struct<s,e>>, singles array<int>): runs of ``least`` or more as ranges, the rest as singles."""
    runs = islands(pins.select(*by, "pincode").distinct(), by)
    ranges = F.array_sort(F.collect_list(F.when(F.col("n") >= least, F.struct(F.col("lo").alias("s"), F.col("hi").alias("e")))))
    singles = F.array_sort(F.flatten(F.collect_list(F.when(F.col("n") < least, F.sequence("lo", "hi")))))
    return runs.groupBy(*by).agg(ranges.alias("ranges"), singles.alias("singles"))


def coverage_mode(served: Column, total: Column) -> Column:
    return F.when(F.coalesce(served, F.lit(0)) == 0, "NOT_SERVED").when(served >= FULL_SHARE * total, "FULL_ZONE").otherwise("ONLY_SERVED")


def state_expansion(pins: DataFrame, master: DataFrame, fewest: int = 2, most_pins: int = 4000, most_zones: int = 2) -> DataFrame:
    """Adds every pincode of a state of which a vendor serves ``fewest`` or more, unless the state is large or mixed."""
    known = master.where("city <> '' and state <> ''")
    states = master.groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("zone").alias("z")).where((F.col("n") <= most_pins) & (F.col("z") <= most_zones))
    hits = pins.select("vendor_id", "pincode").join(known.select("pincode", "state"), "pincode").groupBy("vendor_id", "state").agg(F.count("*").alias("hits")).where(F.col("hits") >= fewest)
    more = hits.join(states.select("state"), "state").join(master.select("pincode", "state"), "state").select("vendor_id", "pincode")
    return pins.select("vendor_id", "pincode").unionByName(more).distinct()


def effective_zones(claims: DataFrame, master: DataFrame) -> DataFrame:
    """One row per vendor and pincode in the master: ``zone`` (its own), ``effective`` (the claimed one), ``oda``."""
    one = claims.groupBy("vendor_id", "pincode").agg(F.max("claimed_zone").alias("claimed_zone"), F.max("oda").alias("oda"))
    return one.join(master.select("pincode", "zone"), "pincode").withColumn("effective", F.coalesce("claimed_zone", "zone"))


def build_serviceability(claims: DataFrame, master: DataFrame) -> DataFrame:
    """Serviceability per vendor and zone: mode, ranges, cross-zone pins, ODA and counts.

    A pincode is served in its own zone, or across zones when the vendor prices it elsewhere.
    Zones without any served pincode are left out. Lists are given as ranges for zones that are
    partly served.
    """
    pins = effective_zones(claims, master)
    own = pins.where("effective = zone").select("vendor_id", "zone", "pincode")
    cross = pins.where("effective <> zone").select("vendor_id", F.col("effective").alias("zone"), "pincode")
    oda = pins.where("oda").select("vendor_id", F.col("effective").alias("zone"), "pincode")
    total = master.groupBy("zone").agg(F.count("*").alias("total"))
    key = ["vendor_id", "zone"]
    count = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    lists = lambda df, name: compress_ranges(df, key).withColumnsRenamed({"ranges": f"{name}_ranges", "singles": f"{name}_singles"})
    zones = count(pins.select("vendor_id", F.col("effective").alias("zone")), "served_count")
    out = zones.join(count(own, "own_count"), key, "left").join(total, "zone", "left")
    out = out.join(lists(own, "served"), key, "left").join(lists(cross, "cross"), key, "left").join(lists(oda, "oda"), key, "left")
    mode = coverage_mode(F.col("own_count"), F.col("total"))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0))
    return out.select(
        *key,
        mode.alias("mode"),
        "total",
        "served_count",
        F.round(F.coalesce("own_count", F.lit(0)) * 100 / F.col("total"), 2).alias("coverage_percent"),
        *[F.when(mode == "ONLY_SERVED", F.col(c)).alias(c) for c in ("served_ranges", "served_singles")],
        "cross_ranges",
        "cross_singles",
        "oda_ranges",
        "oda_singles",
        (empty("served_ranges") + empty("cross_ranges")).alias("n_ranges"),
    )


def decode(coverage: DataFrame, master: DataFrame) -> DataFrame:
    """(vendor_id, pincode, zone): served pincodes of stored coverage; of several zones the last in order counts.

    Full zones take the master's pincodes; ranges are exploded, which is cheap because a range is
    never wider than its zone.
    """
    none_r, none_s = F.array().cast("array<struct<s:int,e:int>>"), F.array().cast("array<int>")
    lists = coverage.select(
        "vendor_id",
        "zone",
        F.explode(
            F.concat(
                expand_ranges(F.coalesce("served_ranges", none_r), F.coalesce("served_singles", none_s)),
                expand_ranges(F.coalesce("cross_ranges", none_r), F.coalesce("cross_singles", none_s)),
            )
        ).alias("pincode"),
    )
    full = coverage.where("mode = 'FULL_ZONE'").select("vendor_id", "zone").join(master.select("zone", "pincode"), "zone")
    order = dims.zones(master.sparkSession).select("zone", "zone_order")
    pins = lists.unionByName(full.select("vendor_id", "zone", "pincode")).join(F.broadcast(order), "zone")
    return pins.groupBy("vendor_id", "pincode").agg(F.max_by("zone", "zone_order").alias("zone"))


def range_lookup(pins: DataFrame, ranges: DataFrame) -> DataFrame:
    """Joins pins to (lo, hi) intervals by blocks of 1000 pincodes, so that a range join is an equi-join."""
    cut = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col("lo") / 1000), F.floor(F.col("hi") / 1000))))
    keyed = pins.withColumn("_block", F.floor(F.col("pincode") / 1000))
    common = [c for c in ("vendor_id",) if c in ranges.columns and c in pins.columns]
    return keyed.join(cut, [*common, "_block"]).where("pincode between lo and hi").drop("_block")


def coverage_stats(coverage: DataFrame, master: DataFrame) -> DataFrame:
    """Per vendor and region, and per vendor in all (region null): served pins, total pins, percent, zones, mean coverage."""
    zones = F.broadcast(dims.zones(master.sparkSession))
    total = master.join(zones, "zone").groupBy("region").agg(F.count("*").alias("region_total"))
    rows = coverage.join(zones, "zone")
    active = F.col("mode") != "NOT_SERVED"
    return (
        rows.rollup("vendor_id", "region")
        .agg(
            F.sum("served_count").alias("served"),
            F.sum((active | (F.col("served_count") > 0)).cast("int")).alias("zones_served"),
            F.round(F.avg(F.when(active, F.col("coverage_percent"))), 2).alias("avg_coverage"),
            F.array_sort(F.collect_set(F.when(active, F.col("zone")))).alias("active_zones"),
        )
        .where("vendor_id is not null")
        .join(total, "region", "left")
        .withColumn("percent", F.round(F.col("served") * 100 / F.col("region_total"), 2))
    )


def fullest_blocks(blocks: DataFrame) -> DataFrame:
    """Of the serviceability blocks (vendor_id, piece, zone, ...) of a vendor the one with most zones; the first of equals."""
    zones = F.size(F.collect_set("zone").over(Window.partitionBy("vendor_id", "piece")))
    first = F.dense_rank().over(Window.partitionBy("vendor_id").orderBy(F.desc("_n"), "piece"))
    return blocks.withColumn("_n", zones).withColumn("_r", first).where("_r = 1").drop("_n", "_r")


def normalize_service(rows: DataFrame) -> DataFrame:
    """Zone entries in either spelling of their fields, in the canonical one; unknown zones are dropped, unknown modes are not served."""
    table = F.create_map(*[F.lit(x) for pair in dims.MODES.items() for x in pair])
    mode = F.coalesce(table[F.col("mode")], F.lit("NOT_SERVED"))
    some = lambda *names: F.coalesce(*[F.when(F.size(n) > 0, F.col(n)) for n in names])
    return rows.where(F.col("zone").isin(dims.ZONES)).select(
        "vendor_id",
        "zone",
        mode.alias("mode"),
        F.when(mode == "FULL_MINUS_EXCEPT", some("exceptRanges", "excludedRanges")).alias("except_ranges"),
        F.when(mode == "ONLY_SERVED", some("servedRanges", "includedRanges")).alias("served_ranges"),
        F.coalesce("totalInZone", "totalCount", F.lit(0)).alias("total"),
    )
