"""Sheet detectors worked by hand: matrices with odd columns, hub codes, lists without headers."""

import pytest

from lanegrid.operators import grids, pin_sheets, zone_sheets
from lanegrid.operators.sheet_cells import is_zone_token

GRID = "vendor_id int, sheet string, row_idx int, cells array<string>"


def grid(spark, sheets):
    return spark.createDataFrame([(v, name, i, c) for (v, name), rows in sheets.items() for i, c in enumerate(rows)], GRID)


def rates(rows):
    return {(r["vendor_id"], r["origin"], r["dest"]): r["rate"] for r in rows.collect()}


def test_zone_tokens(spark):
    cells = ["n1", "North-East", "N1/NCR", "E1+E2", "N1 Delhi side", "12", "3.5", "", None, "rates", "zone"]
    rows = spark.createDataFrame([(x,) for x in cells], "c string").select(is_zone_token(rows_c()).alias("z")).collect()
    assert [r["z"] for r in rows] == [True, True, True, True, True, False, False, False, False, False, False]


def rows_c():
    from pyspark.sql import functions as F

    return F.col("c")


def test_wide_matrix_columns_and_origins(spark):
    """A two-row header, a misspelt and a joined column, days as numbers, a serial number between origin and zones, a row whose origin stands in the first column."""
    rows = [
        ["Rates from", "", "", "NORTH", "SOUTH", "", ""],
        ["Origin", "Sr. No.", "Days", "N1", "S1/S2", "Westren India", "3"],
        ["N1", "1", "2", "10", "20", "30", "99"],
        ["Southrn", "2", "2", "11", "21", "31", "99"],
        ["E1", "3", "2", "12", "23", "-", "99"],
        ["notes", "4", "2", "77", "77", "77", "99"],
    ]
    got = rates(zone_sheets.wide_matrix(grid(spark, {(1, "m"): rows})))
    expected = {(1, o, d): r for o, row in (("N1", (10, 20, 30)), ("E1", (12, 23, None))) for d, r in (("N1", row[0]), ("S1", row[1]), ("S2", row[1]), ("W1", row[2]), ("W2", row[2])) if r}
    expected |= {(1, o, d): r for o in ("S1", "S2", "S3", "S4") for d, r in (("N1", 11), ("S1", 21), ("S2", 21), ("W1", 31), ("W2", 31))}
    assert got == expected


def test_wide_matrix_by_hub_key(spark):
    """Hub codes across and down; with a key, nothing is matched by spelling; another vendor has none and finds none."""
    rows = [["x", "y"], ["", "From", "DEL", "GAU", "N2", "Southrn"], ["", "DEL", "1", "2", "3", "4"], ["", "GAU", "5", "6", "7", "8"], ["", "N2", "9", "10", "11", "12"], ["", "E1", "13", "14", "15", "16"]]
    header = [["x", "y"], ["", "From", "DEL", "GAU", "N2", "N3"], *rows[2:]]
    hubs = spark.createDataFrame([(1, "DEL", "N1"), (1, "GAU", "NE1"), (1, "IMP", "NE2")], "vendor_id int, hub string, zone string")
    got = rates(zone_sheets.wide_matrix(grid(spark, {(1, "a"): header}), hubs=hubs))
    assert {k[1] for k in got} == {"N1", "NE1", "N2", "E1"} and {k[2] for k in got} == {"N1", "NE1", "N2", "N3"}
    assert got[1, "NE1", "N1"] == 5 and got[1, "E1", "N3"] == 16
    few = rates(zone_sheets.wide_matrix(grid(spark, {(1, "a"): [rows[0], ["", "From", "N1", "N2", "Southrn", "qqq"], *rows[2:]]}), hubs=hubs))
    assert few == {}


def test_long_matrix(spark):
    """Unknown labels stand for themselves, later rows overwrite, three rows are no sheet."""
    rows = [["From", "To", "Rate"], ["N1", "Hub 7", "5"], ["NORTH-EAST", "S1", "6"], ["xyz", "S1", "7"], ["N1", "Hub 7", "8"], ["N2", "", "9"]]
    got = rates(grids.long_matrix(grid(spark, {(1, "a"): rows, (2, "a"): rows[:3]})))
    assert got == {(1, "N1", "HUB 7"): 8, (1, "NE1", "S1"): 6, (1, "NE2", "S1"): 6, (1, "XYZ", "S1"): 7}


def pins(rows):
    return sorted((r["vendor_id"], r["pincode"], r["zone_label"], r["oda"]) for r in rows.collect())


@pytest.mark.parametrize("name", ["Pin code no.", "PINNO", "Dest Pin", "loc code"])
def test_pincode_headers(spark, name):
    """Names and telling parts of up to three words; a title of more words is none."""
    rows = [["VX all India pin code list"], ["City", name, "State Code", "ODA/EDL", "Serviceable"], ["a", "110001", "dl", "", "Y"], ["b", "110 002", "", "ODA-B", "N"], ["c", "110003", "dl", "no", "NS"], ["d", "4,00,001.0", "mh", "", ""]]
    assert pins(pin_sheets.pincode_list(grid(spark, {(1, "list"): rows}))) == [(1, 110001, "DL", False), (1, 110002, None, True), (1, 400001, "MH", False)]


def test_pincode_category_and_many_in_a_cell(spark):
    rows = [["Pincode", "Category"], ["560001", "STD"], ["560002", "ODA A"], ["560003, 560004/560005", "ODA B"], ["560010-560012", ""]]
    got = pins(pin_sheets.pincode_list(grid(spark, {(1, "list"): rows})))
    assert [(p, oda) for _, p, _, oda in got] == [(560001, False), (560002, True), (560003, False), (560004, False), (560005, False), (560010, False), (560011, False), (560012, False)]


def test_pincode_lists_without_header(spark):
    """By profile, by cells that list several, a sheet of remote areas by its name, and too few."""
    plain = [["x", "500001"], ["y", "500002"], ["z", "n/a"], ["w", "500003"]]
    listed = [["", "all: 600001, 600002, 600003, 600004"], ["more", "600005 600006 600007; 600008, 600009, 600010, 600011"]]
    few = [["a", "700001"], ["b", "700002"]]
    got = pins(pin_sheets.pincode_list(grid(spark, {(1, "Book1"): plain, (2, "areas"): listed, (3, "Out of Delivery"): plain, (4, "few"): few, (5, "short"): [listed[0]]})))
    assert [g for g in got if g[0] == 1] == [(1, p, None, False) for p in (500001, 500002, 500003)]
    assert [g[1] for g in got if g[0] == 2] == list(range(600001, 600012))
    assert [g for g in got if g[0] == 3] == [(3, p, None, True) for p in (500001, 500002, 500003)]
    assert not [g for g in got if g[0] > 3]


def test_rows_of_a_slanted_page(spark):
    """Words drift down by 3 each; a row ends where one lies over 6 below its first word, not where it leaves the word before."""
    schema = "page int, top double, left double, right double, height double, confidence double, text string"
    words = [(1, 3.0 * i, 60.0 * i, 60.0 * i + 10, 10.0, 90.0, f"w{i}") for i in range(7)] + [(1, 0.0, 500.0, 510.0, 10.0, 10.0, "unsure")]
    got = {r["row"]: r["cells"] for r in grids.ocr_words_to_grid(spark.createDataFrame(words, schema), ["page"]).collect()}
    assert got == {0: ["w0", "w1", "w2"], 1: ["w3", "w4", "w5"], 2: ["w6"]}


def test_company_fields(spark):
    """Names of the dictionary, spelt as in sheets, and one that is only like one of them."""
    rows = [["Carrier Name", "Alpha Cargo"], ["E-Mail", "x@alpha.example"], ["CIN No", "U123"], ["Registered Adress", "Road 5"], ["Province", "Goa"]]
    got = {r["field"]: r["value"] for r in grids.company_rows(grid(spark, {(1, "Company"): rows})).collect()}
    assert got["name"] == "Alpha Cargo" and got["email"] == "x@alpha.example" and got["cin"] == "U123" and got["state"] == "Goa" and got["address"] == "Road 5"
