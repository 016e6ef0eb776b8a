"""Fixed dimensions: zones, regions, coordinates, prefix rules, label maps and modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values ---------------------------------------------------------------------------------

REGIONS = {
    "North": ["N1", "N2", "N3", "N4"],
    "South": ["S1", "S2", "S3", "S4"],
    "East": ["E1", "E2"],
    "West": ["W1", "W2", "W3"],
    "Central": ["C1", "C2"],
    "North East": ["NE1", "NE2"],
    "Special": ["X1", "X2", "X3"],
}

COORDINATES = {
    "N1": (28.7, 77.1), "N2": (26.8, 80.9), "N3": (27.0, 74.6), "N4": (30.7, 76.7),
    "S1": (13.1, 80.3), "S2": (12.9, 77.6), "S3": (17.4, 78.5), "S4": (10.0, 76.3),
    "E1": (22.6, 88.4), "E2": (25.6, 85.1),
    "W1": (19.1, 72.9), "W2": (18.5, 73.9),
    "C1": (23.3, 77.4), "C2": (21.1, 79.1),
    "NE1": (26.1, 91.7), "NE2": (25.6, 94.1),
    "X1": (11.6, 92.7), "X2": (10.6, 72.6), "X3": (34.1, 74.8),
}

PREFIX1 = {
    "1": ["N1", "N2", "N3", "N4", "X3"],
    "2": ["C2", "N1", "N2", "N3", "N4"],
    "3": ["C2", "N1", "N2", "N3", "W1", "W2", "W3"],
    "4": ["C1", "C2", "E2", "N3", "S2", "W1", "W2", "W3"],
    "5": ["C2", "E2", "S1", "S2", "S3", "W2"],
    "6": ["S1", "S2", "S3", "S4", "X2"],
    "7": ["E1", "E2", "NE1", "NE2", "X1"],
    "8": ["E1", "E2", "NE2"],
    "9": ["E2"],
}

PREFIX2 = {
    "11": ["N1"], "12": ["N1", "N2", "N3", "N4"], "13": ["N1", "N2", "N3", "N4"], "14": ["N2", "N3", "N4", "X3"], "15": ["N2", "N3"],
    "16": ["N1", "N2", "N3"], "17": ["N4"], "18": ["N4", "X3"], "19": ["X3"],
    "20": ["N1", "N3", "N4"], "21": ["N1", "N3", "N4"], "22": ["N3", "N4"], "23": ["N3", "N4"], "24": ["N3", "N4"], "25": ["N3", "N4"],
    "26": ["N2", "N4"], "27": ["N1", "N3", "N4"], "28": ["N1", "N3", "N4"],
    "30": ["N1", "N3"], "31": ["N1", "N3"], "32": ["N3"], "33": ["N3"], "34": ["N3"],
    "36": ["W1", "W2"], "37": ["W1", "W2"], "38": ["W1", "W2"], "39": ["W1", "W2"],
    "40": ["W1"], "41": ["W1", "W2"], "42": ["W1", "W2"], "43": ["W1", "W2"], "44": ["C1", "W1", "W2"], "45": ["C1", "C2", "W1"],
    "46": ["C1", "C2"], "47": ["C1", "C2"],
    "50": ["S2"], "51": ["S2"], "52": ["S2"], "53": ["S2"], "54": ["S2", "E2"], "55": ["S2", "E2"],
    "56": ["S1"], "57": ["S1", "S2"], "58": ["S1"], "59": ["S2", "S3"],
    "60": ["S1", "S3"], "61": ["S3"], "62": ["S3"], "63": ["S3"], "64": ["S3"], "65": ["S3", "S4"], "66": ["S4"],
    "67": ["S4"], "68": ["S4"], "69": ["S4", "X2"],
    "70": ["E1"], "71": ["E1", "E2"], "72": ["E1", "E2"], "73": ["E1", "E2"], "74": ["E1", "E2"], "75": ["E2"], "76": ["E2"],
    "77": ["E2"], "78": ["NE1", "NE2"], "79": ["NE1", "NE2", "X1"],
    "80": ["E1"], "81": ["E1"], "82": ["E1", "E2"], "83": ["E1", "E2"], "84": ["E1", "E2"], "85": ["E2", "NE2"],
}

LABEL_ZONES = {
    "N": ["N1", "N2", "N3", "N4"], "NORTH": ["N1", "N2", "N3", "N4"], "NORTH INDIA": ["N1", "N2", "N3", "N4"], "NORTHERN": ["N1", "N2", "N3", "N4"], "NORTHERN INDIA": ["N1", "N2", "N3", "N4"], "NORTH ZONE": ["N1", "N2", "N3", "N4"],
    "S": ["S1", "S2", "S3", "S4"], "SOUTH": ["S1", "S2", "S3", "S4"], "SOUTH INDIA": ["S1", "S2", "S3", "S4"], "SOUTHERN": ["S1", "S2", "S3", "S4"], "SOUTHERN INDIA": ["S1", "S2", "S3", "S4"], "SOUTH ZONE": ["S1", "S2", "S3", "S4"],
    "E": ["E1", "E2"], "EAST": ["E1", "E2"], "EAST INDIA": ["E1", "E2"], "EASTERN": ["E1", "E2"], "EASTERN INDIA": ["E1", "E2"], "EAST ZONE": ["E1", "E2"],
    "W": ["W1", "W2"], "WEST": ["W1", "W2"], "WEST INDIA": ["W1", "W2"], "WESTERN": ["W1", "W2"], "WESTERN INDIA": ["W1", "W2"], "WEST ZONE": ["W1", "W2"],
    "C": ["C1", "C2"], "CENTRAL": ["C1", "C2"], "CENTRAL INDIA": ["C1", "C2"], "CENTRAL ZONE": ["C1", "C2"],
    "NE": ["NE1", "NE2"], "NORTHEAST": ["NE1", "NE2"], "NORTH EAST": ["NE1", "NE2"], "NORTH-EAST": ["NE1", "NE2"], "NORTHEASTERN": ["NE1", "NE2"], "NE INDIA": ["NE1", "NE2"], "NORTH EAST INDIA": ["NE1", "NE2"],
    "NE/JK": ["NE1", "NE2", "X3"], "NE + J&K": ["NE1", "NE2", "X3"],
    "J&K": ["X3"], "JK": ["X3"], "J AND K": ["X3"], "JAMMU": ["X3"], "JAMMU AND KASHMIR": ["X3"], "JAMMU & KASHMIR": ["X3"], "KASHMIR": ["X3"], "LADAKH": ["X3"], "LEH": ["X3"], "LEH LADAKH": ["X3"], "J&K/LADAKH": ["X3"], "JAMMU/LADAKH": ["X3"],
    "ANDAMAN": ["X1"], "A&N": ["X1"], "A & N": ["X1"], "ANDAMAN AND NICOBAR": ["X1"], "ANDAMAN & NICOBAR": ["X1"], "ANDAMAN NICOBAR": ["X1"],
    "LAKSHADWEEP": ["X2"], "LAKSHADWIP": ["X2"], "LAKSHWADEEP": ["X2"],
    "ZONE A": ["N1", "N2"], "ZONE 1": ["N1", "N2"], "Z1": ["N1", "N2"],
    "ZONE B": ["N3", "N4"], "ZONE 2": ["N3", "N4"], "Z2": ["N3", "N4"],
    "ZONE C": ["E1", "E2"], "ZONE 3": ["E1", "E2"], "Z3": ["E1", "E2"],
    "ZONE D": ["W1", "W2"], "ZONE 4": ["W1", "W2"], "Z4": ["W1", "W2"],
    "ZONE E": ["S1", "S2", "S3", "S4"], "ZONE 5": ["S1", "S2", "S3", "S4"], "Z5": ["S1", "S2", "S3", "S4"],
    "ZONE F": ["C1", "C2"], "ZONE 6": ["C1", "C2"], "Z6": ["C1", "C2"],
    "ZONE G": ["NE1", "NE2"], "ZONE 7": ["NE1", "NE2"], "Z7": ["NE1", "NE2"],
    "ZONE 8": ["X1", "X2", "X3"],
    "METRO": ["N1", "S1", "E1", "W1"], "METROS": ["N1", "S1", "E1", "W1"], "METRO CITIES": ["N1", "S1", "E1", "W1"],
    "REST": ["N2", "N3", "N4", "S2", "S3", "S4", "E2", "W2", "C1", "C2"], "REST OF INDIA": ["N2", "N3", "N4", "S2", "S3", "S4", "E2", "W2", "C1", "C2"], "NON METRO": ["N2", "N3", "N4", "S2", "S3", "S4", "E2", "W2", "C1", "C2"],
    "REST OF NORTH": ["N2", "N3", "N4"],
    "REST OF SOUTH": ["S2", "S3", "S4"],
    "DELHI NCR": ["N1"], "DELHI": ["N1"], "NCR": ["N1"],
    "MUMBAI": ["W1"], "PUNE": ["W1"], "AHMEDABAD": ["W1"],
    "BENGALURU": ["S1"], "BANGALORE": ["S1"], "CHENNAI": ["S1"],
    "HYDERABAD": ["S2"],
    "KOLKATA": ["E1"],
    "ANDHRA PRADESH": ["E2", "S2", "S3"], "AP": ["E2", "S2", "S3"],
    "ARUNACHAL PRADESH": ["NE2"], "MEGHALAYA": ["NE2"], "MIZORAM": ["NE2"], "NAGALAND": ["NE2"], "TRIPURA": ["NE2"],
    "ASSAM": ["NE1", "NE2"],
    "BIHAR": ["E1", "E2"], "JHARKHAND": ["E1", "E2"], "JH": ["E1", "E2"], "ODISHA": ["E1", "E2"], "ORISSA": ["E1", "E2"], "OR": ["E1", "E2"], "WEST BENGAL": ["E1", "E2"], "WB": ["E1", "E2"],
    "CHANDIGARH": ["N1", "N3"],
    "CHHATTISGARH": ["C1", "C2", "E2", "N3"], "CHATTISGARH": ["C1", "C2", "E2", "N3"],
    "GOA": ["W2"],
    "GUJARAT": ["W1", "W2"], "GJ": ["W1", "W2"],
    "HARYANA": ["N1", "N3", "N4"], "HR": ["N1", "N3", "N4"],
    "HIMACHAL PRADESH": ["N4"], "HP": ["N4"],
    "KARNATAKA": ["S1", "S2", "W2"], "KA": ["S1", "S2", "W2"],
    "KERALA": ["S3", "S4"], "KL": ["S3", "S4"],
    "MADHYA PRADESH": ["C1", "C2"], "MP": ["C1", "C2"],
    "MAHARASHTRA": ["C1", "S2", "W1", "W2"], "MH": ["C1", "S2", "W1", "W2"],
    "PUDUCHERRY": ["S3"], "PONDICHERRY": ["S3"],
    "PUNJAB": ["N1", "N2", "N3"], "PB": ["N1", "N2", "N3"],
    "RAJASTHAN": ["N1", "N3"], "RJ": ["N1", "N3"],
    "SIKKIM": ["E2", "NE2"],
    "TAMIL NADU": ["S1", "S3"], "TAMILNADU": ["S1", "S3"], "TN": ["S1", "S3"],
    "TELANGANA": ["S1", "S2"], "TS": ["S1", "S2"],
    "UTTAR PRADESH": ["N1", "N3", "N4"], "UP": ["N1", "N3", "N4"],
    "UTTARAKHAND": ["N2", "N3", "N4"], "UK": ["N2", "N3", "N4"], "UTTARANCHAL": ["N2", "N3", "N4"],
}

#: State names looked for inside labels, and their zones.
STATE_ZONES = {
    "ANDAMAN & NICOBAR ISLANDS": ["X1"],
    "ANDHRA PRADESH": ["E2", "S2", "S3"],
    "ARUNACHAL PRADESH": ["NE2"],
    "ASSAM": ["NE1", "NE2"],
    "BIHAR": ["E1", "E2"],
    "CHANDIGARH": ["N1", "N3"],
    "CHHATTISGARH": ["C1", "C2", "E2", "N3"],
    "DELHI": ["N1"],
    "GOA": ["W2"],
    "GUJARAT": ["W1", "W2"],
    "HARYANA": ["N1", "N3", "N4"],
    "HIMACHAL PRADESH": ["N4"],
    "JAMMU AND KASHMIR": ["N4"],
    "JHARKHAND": ["E1", "E2"],
    "KARNATAKA": ["S1", "S2", "W2"],
    "KERALA": ["S3", "S4"],
    "LADAKH": ["X3"],
    "LAKSHADWEEP": ["X2"],
    "MADHYA PRADESH": ["C1", "C2"],
    "MAHARASHTRA": ["C1", "S2", "W1", "W2"],
    "MEGHALAYA": ["NE2"],
    "MIZORAM": ["NE2"],
    "NAGALAND": ["NE2"],
    "ODISHA": ["E1", "E2"],
    "PUDUCHERRY": ["S3"],
    "PUNJAB": ["N1", "N2", "N3"],
    "RAJASTHAN": ["N1", "N3"],
    "SIKKIM": ["E2", "NE2"],
    "TAMIL NADU": ["S1", "S3"],
    "TELANGANA": ["S1", "S2"],
    "TRIPURA": ["NE2"],
    "UTTAR PRADESH": ["N1", "N3", "N4"],
    "UTTARAKHAND": ["N2", "N3", "N4"],
    "WEST BENGAL": ["E1", "E2"],
    "J&K": ["N4"],
    "J AND K": ["N4"],
    "JAMMU & KASHMIR": ["N4"],
    "ANDAMAN AND NICOBAR": ["X1"],
    "PONDICHERRY": ["S3"],
    "ORISSA": ["E1", "E2"],
    "UTTARANCHAL": ["N2", "N3", "N4"],
    "CHATTISGARH": ["C1", "C2", "E2", "N3"],
    "TAMILNADU": ["S1", "S3"],
    "THE DADRA AND NAGAR HAVELI AND DAMAN AND DIU": ["W2"],
    "DADRA AND NAGAR HAVELI": ["W2"],
    "DAMAN AND DIU": ["W2"],
}

MODES = {
    "FULL_ZONE": "FULL_ZONE",
    "FULL_MINUS_EXCEPT": "FULL_MINUS_EXCEPT",
    "FULL_MINUS_EXCEPTIONS": "FULL_MINUS_EXCEPT",
    "EXCLUDING": "FULL_MINUS_EXCEPT",
    "ONLY_SERVED": "ONLY_SERVED",
    "INCLUDING": "ONLY_SERVED",
    "NOT_SERVED": "NOT_SERVED",
}

# ----------------------------------------------------------------------------------------------

ZONES = [z for zones in REGIONS.values() for z in zones]
EARTH_KM = 6371.0


def zones(spark: SparkSession) -> DataFrame:
    """(zone, region, zone_order): 20 rows; reports follow zone_order."""
    rows = [(z, r, ZONES.index(z)) for r, members in REGIONS.items() for z in members]
    return spark.createDataFrame(rows, "zone string, region string, zone_order int").coalesce(1)


def coordinates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(z, *c) for z, c in COORDINATES.items()], "zone string, lat double, lon double").coalesce(1)


def prefix_zones(spark: SparkSession) -> DataFrame:
    """(prefix, zones): zones that a first digit, or the first two, can mean."""
    rows = list({**PREFIX1, **PREFIX2}.items())
    return spark.createDataFrame(rows, "prefix string, zones array<string>").coalesce(1)


def label_zones(spark: SparkSession) -> DataFrame:
    """(label, zones): vendor labels, with every canonical code as its own label."""
    rows = list(LABEL_ZONES.items()) + [(z, [z]) for z in ZONES]
    return spark.createDataFrame(rows, "label string, zones array<string>").coalesce(1)


def _values(rows: list[tuple]) -> str:
    def literal(x):
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "[" + ", ".join(map(literal, x)) + "]" if isinstance(x, list) else repr(x)

    return "VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


#: The same dimensions as DuckDB common table expressions.
SQL = {
    "zones(zone, region, zone_order)": _values([(z, r, ZONES.index(z)) for r, members in REGIONS.items() for z in members]),
    "coords(zone, lat, lon)": "SELECT zone, lat::DOUBLE, lon::DOUBLE FROM (" + _values([(z, *c) for z, c in COORDINATES.items()]) + ") t(zone, lat, lon)",
    "prefixes(prefix, zones)": _values(list({**PREFIX1, **PREFIX2}.items())),
    "labels_dim(label, zones)": _values(list(LABEL_ZONES.items()) + [(z, [z]) for z in ZONES]),
}
