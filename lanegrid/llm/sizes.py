"""Joins that broadcast a side only after its size was checked, and names for helper columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 8_000_000
SALTS = 16
BITMAPS = 512


def small_enough(df: DataFrame, row_bytes: int | Column) -> bool:
    """Whether ``df`` has few enough rows and bytes to be sent to every executor."""
    rows, size = df.agg(F.count("*"), F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).collect()[0]
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def join_counted(big: DataFrame, small: DataFrame, on: list[str], spread: str, row_bytes: int | Column = 64) -> DataFrame:
    """Joins on ``on``. ``small`` is broadcast if it is small enough.

    Beyond that both sides are shuffled by the key and a salt taken from the column ``spread``
    of ``big``, so that a hot key is dealt over SALTS tasks.
    """
    if small_enough(small, row_bytes):
        return big.join(F.broadcast(small), on)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"]).drop("_salt")


def maybe_listed(rows: DataFrame, key: list, listed: DataFrame, listed_key: list) -> DataFrame:
    """The rows whose key hashes to a bit that a row of ``listed`` sets: all rows with a listed key, and few others.

    The bits are in BITMAPS bitmaps of 4 kB, broadcast whatever the size of ``listed``. When they
    fill up, more rows pass; it spares work before an exact join and decides nothing.
    """
    place = lambda cols: F.xxhash64(F.lit(3), *cols)
    bucket = lambda h: F.pmod(h, F.lit(BITMAPS)).cast("int")
    bit = lambda h: F.pmod(F.shiftright(h, 20), F.lit(32768))
    h = place(listed_key)
    maps = listed.groupBy(bucket(h).alias("_bucket")).agg(F.bitmap_construct_agg(bit(h)).alias("_map"))
    at = bit(F.col("_place"))
    byte = F.conv(F.hex(F.substring("_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_place", place(key)).withColumn("_bucket", bucket(F.col("_place"))).join(F.broadcast(maps), "_bucket")
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def free(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it (Spark ignores letter case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
