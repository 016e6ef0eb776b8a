"""Vendor files as tables: JSON pieces, delimited grids, file lists, text grids, and document sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegrid.operators.documents import EXTENSIONS
from lanegrid.sources.delimited import read_records

PIECE = (
    "vendor_id bigint, company_details struct<name:string,gstNo:string>, company struct<name:string,gstNo:string>, name string, gstNo string, "
    "charges map<string,double>, pricing map<string,double>, zone_matrix map<string,map<string,double>>"
)


def read_pieces(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(vendor_id, name, gstNo, charges, zone_matrix) of JSON pieces, wrapped in ``company_details`` or flat."""
    raw = spark.read.schema(PIECE).option("multiLine", multi_line).json(path)
    return raw.select(
        "vendor_id",
        F.coalesce("company_details.name", "company.name", "name").alias("name"),
        F.coalesce("company_details.gstNo", "company.gstNo", "gstNo").alias("gstNo"),
        F.coalesce("charges", "pricing").alias("charges"),
        "zone_matrix",
    )


def read_grid(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, row_idx, cells) of delimited text without a header, as ``delimited`` reads it; cells trimmed, blank rows dropped."""
    rows = read_records(spark, path, separator).withColumn("cells", F.transform("cells", cell_text))
    return rows.where(F.exists("cells", lambda c: c != ""))


def cell_text(cell: Column) -> Column:
    """A cell as text; the ``.0`` of whole numbers goes."""
    return F.regexp_replace(F.trim(cell), r"^(-?\d+)\.0$", "$1")


def text_grid(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row_idx, cells): lines of text cut at tabs, two or more spaces, or bars; empty lines and rules are dropped."""
    lines = rows.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("row_idx", "line"))
    lines = lines.where((F.trim("line") != "") & ~F.trim("line").startswith("---"))
    cells = F.filter(F.transform(F.split("line", r"\t| {2,}|\|"), lambda c: F.trim(c)), lambda c: c != "")
    return lines.select(key, "row_idx", cells.alias("cells")).where(F.size("cells") > 0)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, extension, size) under a folder, without hidden and temporary names and unknown extensions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return files.where(~name.startswith(".") & ~name.startswith("~") & extension.isin(EXTENSIONS)).select(F.col("path").alias("file"), extension.alias("extension"), F.col("length").alias("size"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One folder of JSON per vendor."""
    documents.write.mode("overwrite").partitionBy("vendor_id").json(path)
