"""Worked examples and invariants."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lanegrid.functions import charges, pincodes
from lanegrid.operators import coverage, documents, grids, labels, rates, text
from lanegrid.plans.fixtures import claims, master
from lanegrid.plans.fixtures import rates as rates_view
from lanegrid.streaming import learning
from lanegrid.streaming.learning import step
from tests.conftest import SF


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return row.select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    ("text", "value"),
    [("8.50+0.50", 8.5), ("1:4750", 4750.0), ("28316.85/10", 2831.685), ("5/0", None), ("Rs. 1,250", 1250.0), ("INR 75 /-", 75.0), ("20%", 20.0), ("NIL", None), ("-", None), ("@4%", 4.0), ("abc", None)],
)
def test_parse_number(spark, text, value):
    assert one(spark, charges.parse_number(F.col("t")), t=text) == value


@pytest.mark.parametrize(
    ("text", "v", "f"),
    [("4% or Rs 990", 4.0, 990.0), ("Rs. 3.0/Kg or Rs. 550/consignment (higher)", 3.0, 550.0), ("0.1% on invoice value + Rs. 100 flat", 0.1, 100.0), ("20%", 20.0, None), ("750", None, 750.0), ("Rs 990", None, 990.0)],
)
def test_parse_vf(spark, text, v, f):
    got = one(spark, charges.parse_vf(F.col("t")), t=text)
    assert (got["v"], got["f"]) == (v, f)


@pytest.mark.parametrize(
    ("text", "pins"),
    [("110001 to 110004", [110001, 110002, 110003, 110004]), ("110001-110900", [110001, 110900]), ("110 001, 110002", [110001, 110002]), ("1100012", []), ("none", [])],
)
def test_extract_pincodes(spark, text, pins):
    assert one(spark, pincodes.extract_pincodes_cell(F.col("t")), t=text) == pins


def test_compress_and_decode(spark):
    pins = [100001, 100002, 100003, 100005, 100007, 100008, 100001]
    df = spark.createDataFrame([(1, p) for p in pins], "vendor_id int, pincode int")
    row = coverage.compress_ranges(df, ["vendor_id"]).collect()[0]
    assert [tuple(r) for r in row["ranges"]] == [(100001, 100003)]
    assert row["singles"] == [100005, 100007, 100008]
    back = one(spark, pincodes.expand_ranges(F.array(F.struct(F.lit(100001).alias("s"), F.lit(100003).alias("e"))), F.array(F.lit(100005))))
    assert back == [100001, 100002, 100003, 100005]


def test_decoded_coverage_is_what_was_served(spark):
    m, c = master(spark, SF), claims(spark, SF)
    served = coverage.effective_zones(c, m).select("vendor_id", "pincode")
    decoded = coverage.decode(coverage.build_serviceability(c, m), m).select("vendor_id", "pincode")
    assert served.exceptAll(decoded).count() == 0
    assert decoded.exceptAll(served).count() == 0


def test_spread_rule(spark):
    rows = [(1, "N1", "S1", 10.0), (1, "N1", "S1", 12.0), (1, "N1", "X3", 18.0), (1, "N1", "X3", 25.0)]
    df = spark.createDataFrame(rows, "vendor_id int, origin string, dest string, rate double")
    got = {r["dest"]: r["rate"] for r in rates.pick_rate(df, 5.0, inclusive=True).collect()}
    assert got == {"S1": 12.0, "X3": 21.5}


def test_diff_with_itself_is_empty(spark):
    zones = spark.createDataFrame([(0, "N1", "FULL_ZONE", 3)], "pair int, zone string, mode string, served int")
    matrix = spark.createDataFrame([(0, "N1", "S1", 9.5)], "pair int, origin string, dest string, rate double")
    fields = spark.createDataFrame([(0, "fuel", 20.0)], "pair int, field string, value double")
    doc = {"zones": zones, "matrix": matrix, "charges": fields}
    assert documents.diff(doc, doc).count() == 0


def test_label_layers(spark):
    asked = ["Fuel Surcharge", "fuel surcharge india", "docket chargess", "charges of docket", "dockett charges", "xyz", None]
    df = spark.createDataFrame([(a,) for a in asked], "label string")
    got = {r["label"]: (r["value"], r["method"]) for r in labels.match(df, labels.dictionary(spark)).collect()}
    assert got["Fuel Surcharge"] == ("fuel", "exact")
    assert got["fuel surcharge india"] == ("fuel", "normalised")
    assert got["docket chargess"] == ("docketCharges", "substring")
    assert got["dockett charges"] == ("docketCharges", "fuzzy")
    assert "xyz" not in got


def test_learning_step_promotes_after_three_confirmations():
    state = (0.0, 0, None, False)
    for _ in range(3):
        state = step(state, "confirm")
    assert state[3] and abs(state[2] - (1 - 0.5 * 0.65**3)) < 1e-12
    assert step(state, "wrong")[1:3] == (1, state[2] * 0.5)


def test_classify_filename(spark):
    names = {"Alpha Freight Proposal.pdf": "company_details", "pincode_list.xlsx": "zone_data", "Book2 cade rate.xlsx": "zone_data", "fuel-surcharge.pdf": "charges", "scan.png": "company_details", "qqq.xlsx": "charges"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["k"] for r in df.select("n", documents.classify_filename(F.col("n")).alias("k")).collect()} == names


def test_classify_filename_cuts_a_name_once(spark):
    """The words of a name were found again for every keyword and every comparison of scores."""
    df = spark.createDataFrame([("Zone Network.xlsx",)], "n string")
    for kind in (documents.classify_filename, documents.filename_confidence):
        plan = df.select(kind(F.col("n")))._jdf.queryExecution().analyzed().toString()
        assert plan.count("split(") <= 2 and plan.count("regexp_replace(") <= 4  # the expression and its name


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "vendor_id int, pincode int, claimed_zone string, oda boolean, city string, state string")
    m = master(spark, SF)
    assert coverage.build_serviceability(empty, m).count() == 0
    grid = spark.createDataFrame([], "vendor_id int, sheet string, row_idx int, cells array<string>")
    for detector in (grids.long_matrix, grids.wide_matrix, grids.pincode_list, grids.weight_slabs, grids.horizontal_pairs, grids.drop_air_rows):
        assert detector(grid).count() == 0


def test_per_shipment_and_bands_evaluate(spark):
    charge = F.from_json(F.lit('{"type":"weight_band","bands":[{"minKg":0,"maxKg":50,"charge":300},{"minKg":50,"charge":500}]}'), charges.CHARGE)
    assert one(spark, charges.evaluate(charge, F.lit(20.0))) == 300.0
    assert one(spark, charges.evaluate(charge, F.lit(80.0))) == 500.0
    minimum = F.from_json(F.lit('{"type":"per_kg_minimum","perKg":3.0,"minimum":550}'), charges.CHARGE)
    assert one(spark, charges.evaluate(minimum, F.lit(100.0))) == 550.0
    assert one(spark, charges.evaluate(minimum, F.lit(200.0))) == 600.0


#: A line as vendors write it, and what it must yield.
CHARGE_LINES = [
    ("Fuel surcharge: 12.5%", {"fuel": 12.5}), ("FSC: 11 %", {"fuel": 11.0}), ("14% fuel", {"fuel": 14.0}), ("HSD surcharge is 9 %", {"fuel": 9.0}), ("Diesel levy 7.5%", {"fuel": 7.5}), ("Diesel Escalation 3", {"fuel": 3.0}),
    ("Docket charges Rs. 100", {"docketCharges": 100.0}), ("Lorry receipt Rs. 40", {"docketCharges": 40.0}), ("Waybill fee 45", {"docketCharges": 45.0}), ("Consignment note: 55", {"docketCharges": 55.0}), ("docket charges 99999", {}),
    ("GST @ 18%", {"gst": 18.0}), ("18% GST extra", {"gst": 18.0}), ("Goods and Services Tax 12 %", {"gst": 12.0}), ("IGST = 5 %", {"gst": 5.0}), ("GST at current rate is @ 18% for Surface", {"gst": 18.0}), ("GSTIN: 29AAACR5055K1ZB", {}),
    ("GST extra @ 6%", {"gst": 6.0}), ("GST current rate of 12% applicable", {}), ("GST 12% as per rules", {"gst": 12.0}), ("All rates are subject to GST @ 5%", {"gst": 5.0}),
    ("Minimum charges: Rs 250", {"minCharges": 250.0}), ("SFC-Rs-350", {"minCharges": 350.0}), ("Minimum billing Rs 400", {"minCharges": 400.0}), ("Base freight 300", {"minCharges": 300.0}), ("Floor rate Rs. 240", {"minCharges": 240.0}),
    ("Minimum chargeable weight 30 kg", {"minWeight": 30.0}), ("Min. charg. weight: 25 kg", {"minWeight": 25.0}), ("Min wt. 20 kg", {"minWeight": 20.0}), ("SFC - 15 kg", {"minWeight": 15.0}),
    ("1 CFT = 8 kg", {"divisor": 3540.0}), ("1 CFT = 900 kg", {}), ("k factor 4500", {"divisor": 4500.0}), ("L x B x H (in cm) / 5000", {"divisor": 5000.0}), ("1 CFT = 8 kg, volumetric divisor 4000", {"divisor": 4000.0}),
    ("Green tax Rs 35", {"greenTax": 35.0}), ("NGT charge Delhi Rs. 60", {"greenTax": 60.0}), ("Environmental cess 10", {"greenTax": 10.0}), ("Ecology charge 11", {"greenTax": 11.0}), ("Pollution cess 12", {"greenTax": 12.0}),
    ("Owner's risk 0.1 % on freight", {"rovCharges_v": 0.1, "rovCharges_basis": "freight"}), ("FOV minimum Rs. 75", {"rovCharges_f": 75.0}),
    ("ODA charges Rs. 3/kg or Rs. 500/consignment whichever is higher", {"odaCharges_perKg": 3.0, "odaCharges_minimum": 500.0}), ("ODA Rs. 750 per docket", {"odaCharges_f": 750.0}), ("ODA 5 %", {"odaCharges_v": 5.0}),
    ("Insurance 0.3% on invoice", {"insuranceCharges_v": 0.3, "insuranceCharges_basis": "invoice"}), ("Transit insurance Rs 75", {"insuranceCharges_f": 75.0}),
    ("COD charges 1.5 %", {"codCharges_v": 1.5}), ("C.O.D. Rs. 85", {"codCharges_f": 85.0}), ("COD (Cheque/DD on delivery) 70", {"codCharges_f": 70.0}), ("Handling charges Rs. 2", {"handlingCharges_f": 2.0}),
    ("DACC Rs. 150", {"daccCharges": 150.0}), ("Demurrage 20", {"daccCharges": 20.0}), ("DACC (delivery against consignee copy) Rs 12000", {}),
    ("To pay charges 2%", {"topayCharges_v": 2.0}), ("To pay surcharge Rs. 50", {"topayCharges_f": 50.0}), ("To Pay: Rs.55", {"topayCharges_f": 55.0}), ("FOD (Freight on Delivery) 65", {"topayCharges_f": 65.0}), ("Appointment delivery Rs. 900", {"appointmentCharges_f": 900.0}),
]


def test_text_charges_line_by_line(spark):
    df = spark.createDataFrame(list(enumerate(line for line, _ in CHARGE_LINES)), "i int, text string")
    got = {r["i"]: {k: v for k, v in r.asDict().items() if k not in ("i", "text") and v is not None} for r in text.text_charges(df).collect()}
    assert {line: got[i] for i, (line, _) in enumerate(CHARGE_LINES)} == dict(CHARGE_LINES)


def test_streams_over_several_batches(spark, tmp_path):
    """One file a batch: rates of one cell meet, and states go on where the batch before ended."""
    for i, rate in enumerate([10.0, 100.0, 12.0]):
        spark.createDataFrame([(1, "N1", "S1", rate)] + [(1, "N1", "E1", 5.0)] * (i == 0), "vendor_id int, origin string, dest string, rate double").coalesce(1).write.mode("append").parquet(str(tmp_path / "rates"))
    stream = spark.readStream.schema("vendor_id int, origin string, dest string, rate double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rates"))
    learning.ingest_rates(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    got = {(r["origin"], r["dest"]): r["rate"] for r in learning.ingested_matrix(spark, str(tmp_path / "out")).collect()}
    assert got == {("N1", "S1"): 40.67, ("N1", "E1"): 5.0}
    kinds = ["confirm", "confirm", "wrong", "passive", "confirm", "wrong"]
    rows = [("charge", "raw", "m", k, f"2024-01-01 00:00:{i:02d}", i) for i, k in enumerate(kinds)]
    schema = "type string, raw string, canonical string, kind string, ts string, seq long"
    for part in (rows[:2], rows[2:4], rows[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        time.sleep(1.1)  # files are taken in the order of their times
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    learning.write_states(events, str(tmp_path / "states"), str(tmp_path / "c2")).awaitTermination()
    last = [tuple(r) for r in learning.last_states(spark, str(tmp_path / "states")).collect()]
    assert last == [tuple(r) for r in labels.fold_events(spark.createDataFrame(rows, schema)).collect()]
    assert spark.read.parquet(str(tmp_path / "states")).select("batch").distinct().count() == 3


def test_city_matrix_finds_its_header(spark):
    """Worked by hand: a header in the third row, a blank origin, a pincode as destination, an air row."""
    rows = [["Rates"], ["", "North", "x"], ["From/To", "Delhi", "AGRA", "110001", "note"], ["Agra", "5", "6.5", "1,200", ""], ["", "7", "-", "9", ""], ["Delhi", "90", "95", "99", ""], ["nowhere", "1", "2", "3", ""]]
    grid = spark.createDataFrame([(1, "s", i, c) for i, c in enumerate(rows)], "vendor_id int, sheet string, row_idx int, cells array<string>")
    places = spark.createDataFrame([("AGRA", "N2", 0), ("MUMBAI", "W1", 1)], "name string, zone string, dim_order int")
    pins = spark.createDataFrame([(110001, "N3")], "pincode int, zone string")
    got = {(r["origin"], r["dest"]): r["rate"] for r in grids.city_matrix(grid, places, pins).collect()}
    assert got == {("N2", "N1"): 5.0, ("N2", "N2"): 6.5, ("E1", "N1"): 7.0, ("E1", "N3"): 9.0}


def test_city_rate_card_sections(spark):
    """Worked by hand: an origin, two headers, a label by air inside the first section, the second by air."""
    rows = [["Ex Mumbai"], ["Destination", "State", "Rate per kg"], ["Agra", "", "Rs. 10"], ["By Air"], ["Agra", "", "50"], ["By Road"], ["somewhere", "Agra", "13"], ["By air"], ["City", "Freight"], ["Agra", "70"]]
    grid = spark.createDataFrame([(1, "s", i, c) for i, c in enumerate(rows)], "vendor_id int, sheet string, row_idx int, cells array<string>")
    places = spark.createDataFrame([("AGRA", "N2", 0)], "name string, zone string, dim_order int")
    pins = spark.createDataFrame([(110001, "N3")], "pincode int, zone string")
    assert [tuple(r)[2:] for r in grids.city_rate_card(grid, places, pins).collect()] == [("W1", "N2", 13.0)]


def test_charge_values_parse_a_value_once(spark):
    """Every use of a value's pair and number parsed it again."""
    rows = spark.createDataFrame([(1, "charges", 3, ["Fuel Surcharge", "12%"])], "vendor_id int, sheet string, row_idx long, cells array<string>")
    out = grids.charge_values(rows, labels.dictionary(spark))
    assert [(r["field"], r["scalar"], r["row_idx"]) for r in out.collect()] == [("fuel", 12.0, 3)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("consignment") <= 16


def test_rates_shuffle_what_they_need(spark):
    """Orders meet customers before lines do, and a line carries its part's remainder only."""
    plan = rates_view(spark, SF).groupBy("vendor_id", "origin", "dest").agg(F.max("rate"))._jdf.queryExecution().optimizedPlan().toString()
    last = plan.index("(l_orderkey")
    assert "o_custkey" not in plan[:last].split("Join Inner")[1] and "as smallint" in plan


def test_signals_of_odd_texts_are_counted_as_spark_counts(spark):
    """Plain texts go through Arrow, others through Spark; both count alike."""
    rng = random.Random(4)
    parts = ["air", "freight", "awb", "1 cft = 8", "1cft:9kg", "l x b x h", "N1", "NE2", "zone", "rs.", "Rs", "per kg", "5%", "3/-", "110001", "9876543210", "+919876543210", "a@b.co", ".d@e.f"]
    parts += ["gst no", "29ABCDE1234F1Z5", "ABCDE1234F", "oda", "10-20 kg", "5+ kg", "clause 4", "t & c", "1 2 3 4 ", "1.5 2. 3 ", "=5%", ": 7 rs", "y", "_", "\t", "\n", "\f"]
    odd = ["é", "\r", "\x0b", "×", "–", "K", "non\rserviceable"]  # the Kelvin sign is a k where case is folded beyond ASCII
    rows = [(i, "".join(rng.choice(parts + (odd if i % 3 == 0 else [])) + rng.choice(["", " "]) for _ in range(rng.randint(0, 50)))) for i in range(600)] + [(600, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    value = F.coalesce("text", F.lit(""))
    of = lambda p, distinct: F.size(F.array_distinct(F.regexp_extract_all(value, F.lit(p), F.lit(0)))) if distinct else F.regexp_count(value, F.lit(p))
    expected = df.withColumns({f"{c}.{n}": of(p, distinct) for c, signals in text.SIGNALS.items() for n, p, _, distinct in signals})
    got = text.signal_counts(df)
    assert got.columns == expected.columns
    assert sorted(got.drop("text").collect()) == sorted(expected.drop("text").collect())


def test_signals_of_a_long_column_of_numbers(spark):
    """A grid of 100,000 numbers in one text, on which a pattern that backtracks ran out of its stack."""
    df = spark.createDataFrame([("12.5 " * 100_000,)], "text string")
    assert text.signal_counts(df).select("`ZONE_MATRIX.numeric_grid`").collect()[0][0] == 1


def test_rows_of_one_key_are_cut_apart(spark):
    """Blocks do not mix the lines of several texts, and follow line by line from the rule."""
    import re

    rng = random.Random(9)
    pool = ["a plain line of words", "  x  ", "", "", "-----", "--- Page 3", "RATE CARD", "ÄÖ ß", "\tTOTAL", "rates for 12 kg", "N1 N2", "....", "\x0b\r"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(60)] + ["", None, "\n\n", "plain words", "RATE CARD"]
    trim = lambda x: re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", x)
    expected = []
    for key, value in enumerate(texts):
        own, block, before = [trim(x) for x in value.split("\n")] if value is not None else [], [], None
        for i, line in enumerate([*own, None]):
            short = line is not None and line != "" and len(line) < 80 and not re.search("[a-zß-ÿ]", line) and len(re.split(r"[ \t-\r]+", line)) >= 2
            if line is None or short or re.match(r"(?i)---[ \t-\r]*Page[ \t-\r]+\d", line) or re.fullmatch(r"[\-=_*~.]{4,}", line) or (line == "" and before == ""):
                body = trim("\n".join(own[j] for j in block))
                expected += [(key % 3, block[0], block[-1] + 1, body)] if block and len(body) >= 5 else []
                block = []
            else:
                block.append(i)
            before = line
    rows = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(map(tuple, text.segment(rows, least_chars=5).collect())) == sorted(expected)
