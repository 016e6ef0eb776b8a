"""Column functions over charge values.

A charge is a struct (type, scalar, v, f, perKg, minimum, bands): a plain number, a pair of a
percentage and a fixed amount, or a typed shape.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARGE = "struct<type:string,scalar:double,v:double,f:double,perKg:double,minimum:double,bands:array<struct<minKg:double,maxKg:double,charge:double>>>"

# Fixed values ---------------------------------------------------------------------------------
EMPTY_WORDS = ["-", "na", "n/a", "nil", "none", "null", "", "x", "n"]
TABLE_CAPS = {"docketCharges": 2000, "daccCharges": 10000, "codCharges": 5000, "topayCharges": 5000, "greenTax": 2000, "appointmentCharges": 10000}
GST_PATTERN = r"^\d{2}[A-Z]{5}\d{4}[A-Z]\d[A-Z0-9]{2}$"
SOURCE_CONFIDENCE = {"excel": 80, "pdf": 65, "word": 60, "image": 55}
# ----------------------------------------------------------------------------------------------

_NUMBER = r"(\d+(?:\.\d+)?)"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _double(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("double")


def parse_number(text: Column) -> Column:
    """The number of a cell: base of ``a+b``, second of ``a:b``, quotient of ``a/b``, else the first number after units are dropped."""
    t = F.trim(text)
    part = lambda sign, i: _double(F.regexp_extract(t, rf"^{_NUMBER}\s*{sign}\s*{_NUMBER}$", i))
    stripped = F.regexp_replace(F.regexp_replace(t, r"(?i)\binr\b\.?\s*", ""), r"(?i)rs\.?\s*", "")
    stripped = F.regexp_replace(F.regexp_replace(stripped, r"[₹,%]", ""), r"(?i)\s*(kgs?|kg|days?|lrs?|pieces?|per\s+\w+|/-)\s*$", "")
    stripped = F.trim(stripped)
    parts = F.struct(part(r"\+", 1).alias("base"), part(":", 2).alias("second"), part("/", 1).alias("up"), part("/", 2).alias("down"), stripped.alias("s"))

    def choose(p: Column) -> Column:
        plain = F.coalesce(_double(F.regexp_extract(p["s"], rf"(?:^|[@=:]\s*){_NUMBER}", 1)), p["s"].try_cast("double"))
        quotient = F.round(p["up"] / F.nullif(p["down"], F.lit(0.0)), 4)
        return F.coalesce(p["base"], p["second"], F.when(p["down"].isNotNull(), quotient).when(~F.lower(p["s"]).isin(EMPTY_WORDS), plain))

    return let(parts, choose)


def charge_num(text: Column) -> Column:
    """A number, numeric text or percentage; 0 for anything else."""
    n = F.regexp_replace(F.regexp_replace(F.trim(text), "%+$", ""), ",", "").try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 0.0).otherwise(n)


def parse_vf(text: Column) -> Column:
    """Percentage and fixed amount of a description, in order of how specific its form is."""
    amount = r"(?:rs\.?|inr\.?|₹)"
    forms = [
        rf"(?i)(?:rs\.?\s*)?{_NUMBER}\s*/\s*kgs?.*?(?:rs\.?\s*)(\d[\d,]*(?:\.\d+)?)\s*/?\s*(?:consignment|con(?:sign)?|shipment)",
        rf"(?i){_NUMBER}\s*%.*?\+\s*{amount}\s*{_NUMBER}",
        rf"(?i){_NUMBER}\s*%\s*(?:or|/|,)?\s*{amount}?\s*{_NUMBER}",
    ]
    out = None
    for pattern in forms:
        v = _double(F.regexp_extract(text, pattern, 1))
        f = _double(F.replace(F.regexp_extract(text, pattern, 2), F.lit(","), F.lit("")))
        pair = F.struct(v.alias("v"), f.alias("f"))
        out = F.when(text.rlike(pattern), pair) if out is None else out.when(text.rlike(pattern), pair)
    percent = _double(F.regexp_extract(F.trim(text), rf"^{_NUMBER}\s*%$", 1))
    rupees = _double(F.regexp_extract(text, rf"(?i)(?:rs|inr|₹)\.?\s*{_NUMBER}", 1))
    nothing = F.lit(None).cast("double")
    single = F.struct(percent.alias("p"), rupees.alias("r"), parse_number(text).alias("n"))

    def by_size(s: Column) -> Column:
        v = F.when(s["p"].isNotNull(), s["p"]).when(s["r"].isNull() & (s["n"] <= 100), s["n"]).otherwise(nothing)
        f = F.when(s["p"].isNotNull(), nothing).when(s["r"].isNotNull(), s["r"]).when(s["n"] > 100, s["n"])
        return F.struct(v.alias("v"), f.alias("f"))

    return out.otherwise(let(single, by_size))


def scalar_of(c: Column, default: float = 0.0) -> Column:
    """The first non-zero of f, v and the plain number, else the first that is there, else the default."""
    parts = [c["f"], c["scalar"], c["v"]]
    return F.coalesce(*[F.nullif(p, F.lit(0.0)) for p in parts], *parts, F.lit(default))


def vf_of(c: Column) -> Column:
    """(v, f): of a pair as it is; a plain number up to 100 is a percentage, beyond it an amount."""
    n = c["scalar"]
    pair = c["v"].isNotNull() | c["f"].isNotNull()
    zero = F.lit(0.0)
    v = F.when(pair, F.coalesce(c["v"], zero)).when(n <= 100, n).otherwise(zero)
    f = F.when(pair, F.coalesce(c["f"], zero)).when(n > 100, n).otherwise(zero)
    return F.struct(v.alias("v"), f.alias("f"))


def oda_encode(c: Column) -> Column:
    """A charge for remote delivery in its stored shape; a plain whole number of 1..30 is a percentage."""
    n, zero, none = c["scalar"], F.lit(0.0), F.lit(None).cast("double")
    kind = c["type"]
    bands = F.coalesce(F.size(c["bands"]), F.lit(0)) > 0
    least = F.array_min(F.transform(F.filter(c["bands"], lambda b: b["charge"] > 0), lambda b: b["charge"]))
    make = lambda t, v, f, k, m: F.struct(t.alias("type"), v.alias("v"), f.alias("f"), k.alias("perKg"), m.alias("minimum"))
    text = lambda s: F.lit(s).cast("string")
    whole = (n == F.floor(n)) & n.between(1, 30)
    vf = vf_of(c)
    return (
        F.when(bands, make(text("weight_band"), none, none, none, least))
        .when(kind == "per_shipment", make(text("per_shipment"), zero, F.coalesce(F.nullif(c["f"], zero), c["scalar"], zero), none, none))
        .when(
            kind == "per_kg_minimum",
            make(text("per_kg_minimum"), none, none, F.coalesce(F.nullif(c["perKg"], zero), c["v"], zero), F.coalesce(F.nullif(c["minimum"], zero), c["f"], zero)),
        )
        .when(n.isNotNull(), make(text(None), F.when(whole, n).otherwise(zero), F.when(whole, zero).otherwise(n), none, none))
        .otherwise(make(text(None), vf["v"], vf["f"], none, none))
    )


def richness(c: Column) -> Column:
    """How much a charge tells: 0 nothing, 1 a number, more with more parts, 10 and up for tables."""
    parts = sum(((F.coalesce(c[p], F.lit(0.0)) != 0).cast("int") for p in ("v", "f", "perKg", "minimum")), F.lit(0))
    bands = F.coalesce(F.size(c["bands"]), F.lit(0))
    named = F.coalesce(c["type"], F.lit("")) != ""
    return (
        F.when(c.isNull(), 0)
        .when(bands > 0, bands + 10)
        .when(parts > 0, parts + 1 + F.when(named, 2).otherwise(0))
        .when(named | (F.coalesce(c["scalar"], F.lit(0.0)) != 0), 1)
        .otherwise(0)
    )


def equivalent(a: Column, b: Column) -> Column:
    """True if two charges mean the same numbers."""
    close = lambda x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))) < 1e-9
    shape = lambda c: F.struct(c["type"], c["perKg"], c["minimum"], c["bands"])
    return close(a["scalar"], b["scalar"]) & close(a["v"], b["v"]) & close(a["f"], b["f"]) & (shape(a) == shape(b))


def has_value(c: Column) -> Column:
    return c.isNotNull() & (richness(c) > 0)


def evaluate(c: Column, kg: Column) -> Column:
    """The charge for a shipment of ``kg``: additive pair, per kg with a floor, per shipment, or by weight band."""
    zero = F.lit(0.0)
    band = F.filter(c["bands"], lambda b: (kg >= b["minKg"]) & (b["maxKg"].isNull() | (kg <= b["maxKg"])))
    vf = vf_of(c)
    return (
        F.when(F.size(band) > 0, F.get(band, F.lit(0))["charge"])
        .when(c["type"] == "per_kg_minimum", F.greatest(F.coalesce(c["perKg"], zero) * kg, F.coalesce(c["minimum"], zero)))
        .when(c["type"] == "per_shipment", F.coalesce(c["f"], zero))
        .otherwise(vf["f"] + kg * vf["v"] / 100)
    )


def encode_handling(c: Column) -> Column:
    """A handling charge (type, scalar, v, f, perBox, minimum, thresholdWeight): per box with its minimum, else an additive pair with a threshold weight if there is one."""
    pair = vf_of(c)
    box = c["type"] == "per_box"
    plain = F.coalesce(~box, F.lit(True))
    return F.struct(
        F.when(box, "per_box").alias("type"),
        F.when(box, F.coalesce(c["perBox"], F.lit(0.0))).alias("perBox"),
        F.when(box, F.coalesce(c["minimum"], F.lit(0.0))).alias("minimum"),
        F.when(plain, pair["v"]).alias("v"),
        F.when(plain, pair["f"]).alias("f"),
        F.when(plain & (c["thresholdWeight"] > 0), c["thresholdWeight"]).alias("thresholdWeight"),
    )


def encode_invoice(c: Column) -> Column:
    """A charge on the invoice's value (enabled, percentage, minimumAmount, v, f, slabs): null unless something says that it applies."""
    some = lambda x: F.coalesce(x != 0, F.lit(False))
    slabs = F.coalesce(F.size(c["slabs"]) > 0, F.lit(False))
    applies = F.coalesce(c["enabled"], F.lit(False)) | some(c["percentage"]) | some(c["v"]) | slabs
    first = lambda *xs: F.coalesce(*[F.nullif(x, F.lit(0.0)) for x in xs], F.lit(0.0))
    return F.when(
        applies,
        F.struct(F.lit(True).alias("enabled"), first(c["percentage"], c["v"]).alias("percentage"), first(c["minimumAmount"], c["f"]).alias("minimumAmount"), F.when(slabs, "slabs").alias("type"), F.when(slabs, c["slabs"]).alias("slabs")),
    )


def basis(c: Column) -> Column:
    """What a percentage (type, basis) is taken of: invoice or freight, or null."""
    kind = F.coalesce(c["type"], F.lit(""))
    return F.when(kind.contains("invoice") | F.coalesce(c["basis"] == "invoice", F.lit(False)), "invoice").when(kind.contains("freight") | F.coalesce(c["basis"] == "freight", F.lit(False)), "freight")


def gst_number(text: Column) -> Column:
    clean = F.upper(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(clean.rlike(GST_PATTERN), clean)


def under_cap(field: Column, value: Column, caps: dict[str, int] = TABLE_CAPS) -> Column:
    """False for a value over its field's cap."""
    table = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    return F.coalesce(value <= table[field], F.lit(True))


def extraction_confidence(source: Column, direct: Column, extrapolated: Column) -> Column:
    """By kind of source; with extrapolated rates by how many cells were read directly."""
    base = F.create_map(*[F.lit(x) for pair in SOURCE_CONFIDENCE.items() for x in pair])[source]
    return F.when(extrapolated, F.when(direct >= 10, 62).when(direct >= 5, 55).otherwise(45)).otherwise(base)
