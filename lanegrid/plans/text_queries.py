"""Queries of the text family and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanegrid.operators import text as op
from lanegrid.plans.fixtures import sql
from lanegrid.runtime import spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None, **views: str):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle, **views)
        return f

    return register


#: The documents' prose (ASCII only, so that word boundaries mean the same everywhere) followed by a line of a rate card.
CARDS = r"""SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', ' ', 'g') || chr(10) || CASE doc_id % 6
    WHEN 0 THEN 'Fuel surcharge: ' || (doc_id % 40) || '% docket charges Rs. ' || (50 + doc_id % 90) || ' minimum charges Rs ' || (200 + doc_id % 300) || chr(10) || CHARGE_LINES[doc_id // 6 % N_LINES + 1]
    WHEN 1 THEN 'zone N1 N2 S1 W1 rate per kg ' || (5 + doc_id % 9) || ' freight tariff north south'
    WHEN 2 THEN 'serviceable pincode ' || (110000 + doc_id % 900) || ' ' || (400000 + doc_id % 900) || ' coverage area yes'
    WHEN 3 THEN 'GST: 29ABCDE1234F1Z5 phone 98' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || ' mail Sales' || doc_id || '@Example.com logistics company limited pin: ' || (560000 + doc_id % 900)
    WHEN 4 THEN '1 CFT = ' || (6 + doc_id % 6) || ' kg volumetric weight, green tax 35' ELSE 'clause 4 jurisdiction and liability, section 7' END AS text FROM documents"""
#: Further lines of rate cards, one per document with charges.
CHARGE_LINES = [
    "FSC: 12 %", "14% fuel", "HSD surcharge is 9 %", "Diesel levy 7.5%", "Diesel Escalation 3", "Lorry receipt Rs. 40", "Waybill fee 45", "Consignment note: 55", "GST @ 18%", "18% GST extra",
    "Goods and Services Tax 12 %", "GST at current rate is @ 18% for Surface", "All rates are subject to GST @ 5%", "SFC-Rs-350", "Minimum billing Rs 400", "Base freight 300", "Floor rate Rs. 250",
    "Minimum chargeable weight 30 kg", "Min. charg. weight: 25 kg", "Min wt. 20 kg", "SFC - 15 kg", "1 CFT = 8 kg", "k factor 4500", "L x B x H (in cm) / 5000", "NGT charge Delhi Rs. 60", "Environmental cess 10",
    "Ecology charge 11", "Pollution cess 12", "ROV 0.2% of invoice value", "Owner's risk 0.1 % on freight", "ODA charges Rs. 3/kg or Rs. 500/consignment whichever is higher", "ODA 5 %", "Insurance 0.3% on invoice",
    "Transit insurance Rs 75", "COD charges 1.5 %", "C.O.D. Rs. 85", "Handling charges Rs. 2", "DACC Rs. 150", "Demurrage 20", "To pay charges 2%", "To pay surcharge Rs. 50", "To Pay: Rs.55", "Appointment delivery Rs. 900",
    "FOD (Freight on Delivery) 65", "COD (Cheque/DD on delivery) 70", "DACC (delivery against consignee copy) Rs 12000", "docket charges 99999", "1 CFT = 900 kg",
]
CARDS = CARDS.replace("CHARGE_LINES", "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in CHARGE_LINES) + "]").replace("N_LINES", str(len(CHARGE_LINES)))


def cards(spark, d):
    k = F.col("doc_id")
    lit = F.lit
    line = (
        F.when(k % 6 == 0, F.concat(lit("Fuel surcharge: "), k % 40, lit("% docket charges Rs. "), 50 + k % 90, lit(" minimum charges Rs "), 200 + k % 300, lit("\n"), F.element_at(F.array(*map(lit, CHARGE_LINES)), (F.floor(k / 6) % len(CHARGE_LINES) + 1).cast("int"))))
        .when(k % 6 == 1, F.concat(lit("zone N1 N2 S1 W1 rate per kg "), 5 + k % 9, lit(" freight tariff north south")))
        .when(k % 6 == 2, F.concat(lit("serviceable pincode "), 110000 + k % 900, lit(" "), 400000 + k % 900, lit(" coverage area yes")))
        .when(k % 6 == 3, F.concat(lit("GST: 29ABCDE1234F1Z5 phone 98"), F.lpad(k.cast("string"), 8, "0"), lit(" mail Sales"), k, lit("@Example.com logistics company limited pin: "), 560000 + k % 900))
        .when(k % 6 == 4, F.concat(lit("1 CFT = "), 6 + k % 6, lit(" kg volumetric weight, green tax 35")))
        .otherwise(lit("clause 4 jurisdiction and liability, section 7"))
    )
    return spread(table(spark, d, "documents")).select("doc_id", F.concat(F.regexp_replace("text", r"[^\x00-\x7F]", " "), lit("\n"), line).alias("text"))


_Q = lambda p: p.replace("'", "''")
_COUNTS = {
    (c, n): f"len({'list_distinct' if distinct else ''}(regexp_extract_all(text, '{_Q(p)}')))" for c, signals in op.SIGNALS.items() for n, p, _, distinct in signals
}
_SCORES = {
    c: "round(" + " + ".join(f"least(3.0, 2 * log10({_COUNTS[c, n]} + 1)) * {w}" if distinct else f"least({_COUNTS[c, n]}, 5) * {w}" for n, _, w, distinct in signals) + ", 3)" for c, signals in op.SIGNALS.items()
}
_LIST = "[" + ", ".join(f"{{'s': -({s}), 'i': {i}, 'c': '{c}'}}" for i, (c, s) in enumerate(_SCORES.items())) + "]"
CLASSIFIED = f"""SELECT doc_id, CASE WHEN top < {op.LEAST_SCORE} THEN 'UNKNOWN' WHEN second >= {op.LEAST_SCORE} AND (top - second) / top < {op.MIXED_GAP} THEN 'MIXED' ELSE best END AS category,
    CASE WHEN top < {op.LEAST_SCORE} THEN 0 ELSE round(top / total, 3) END AS confidence
    FROM (SELECT doc_id, -r[1].s AS top, -r[2].s AS second, r[1].c AS best, -list_sum(list_transform(r, lambda x: x.s)) AS total FROM (SELECT doc_id, list_sort({_LIST}) AS r FROM cards))"""


@query("classify_text", "SELECT doc_id, category, round(confidence, 2) AS confidence FROM classified", cards=CARDS, classified=CLASSIFIED)
def classify_text(spark, d):
    return op.classify(cards(spark, d)).select("doc_id", "category", F.round("confidence", 2).alias("confidence"))


@query("charge_evidence", "SELECT doc_id, regexp_matches(lower(text), '" + "|".join(p.replace("'", "''") for p in op.EVIDENCE) + "') AS evidence FROM cards", cards=CARDS)
def charge_evidence(spark, d):
    return cards(spark, d).select("doc_id", op.has_charge_evidence(F.col("text")).alias("evidence"))


#: DuckDB's patterns have no look-ahead, so two fields are left to the tests.
_LOOKAHEAD = [f for f, _, p in op.CHARGE_PATTERNS if "(?!" in p]
_VALUES: dict[str, list[str]] = {}
for _f, _, _p in op.CHARGE_PATTERNS:
    _v = f"TRY_CAST(nullif(regexp_extract(low, '{_Q(_p)}', 1), '') AS DOUBLE)"
    _VALUES.setdefault(_f, []).append(f"CASE WHEN {_v} <= {op.TEXT_CAPS[_f]} THEN {_v} END" if _f in op.TEXT_CAPS else _v)
CHARGES_FOUND = "SELECT doc_id, low, " + ", ".join(f"coalesce({', '.join(reversed(v) if f in op.LAST_COUNTS else v)}) AS {f}" for f, v in _VALUES.items() if f not in _LOOKAHEAD) + " FROM (SELECT doc_id, lower(text) AS low FROM cards)"
_FALL = {f: f"coalesce({f}, CASE WHEN coalesce({', '.join(of)}) IS NULL AND TRY_CAST(nullif(regexp_extract(low, '{_Q(p)}', 1), '') AS DOUBLE) < {below} THEN CAST(regexp_extract(low, '{_Q(p)}', 1) AS DOUBLE) END)" for f, (of, below, _, p) in op.FALLBACKS.items()}
_SPECIAL = _FALL | {"odaCharges_v": "CASE WHEN odaCharges_perKg IS NULL THEN odaCharges_v END", "divisor": "coalesce(divisor, CASE WHEN cft_kg > 0 AND cft_kg < 200 THEN round(28316.8 / cft_kg, 0) END)"}
_BASIS = {f.removesuffix("_v") + "_basis": f"regexp_extract(low, '{_Q(p)}[\\s\\S]{{0,40}}', 0)" for f, _, p in op.CHARGE_PATTERNS if f in op.BASED}


@query(
    "text_charges",
    "SELECT doc_id, " + ", ".join(f"{_SPECIAL.get(f, f)} AS {f}" for f in _VALUES if f not in [*_LOOKAHEAD, "cft_kg"]) + ", " + ", ".join(f"CASE WHEN contains({e}, 'invoice') THEN 'invoice' WHEN contains({e}, 'freight') THEN 'freight' END AS {f}" for f, e in _BASIS.items()) + " FROM charges_found",
    cards=CARDS, charges_found=CHARGES_FOUND,
)
def text_charges(spark, d):
    return op.text_charges(cards(spark, d)).drop("text", *_LOOKAHEAD)


_GET = {f: f"nullif(trim(regexp_extract(text, '{p}', 1)), '')" for f, p in op.COMPANY_PATTERNS.items()}


@query(
    "text_company",
    f"""SELECT doc_id, upper({_GET['gstNo']}) AS gstNo, {_GET['panNo']} AS panNo, CASE WHEN starts_with(phone, '0091') AND length(phone) = 14 THEN substr(phone, 5, 10) WHEN starts_with(phone, '91') AND length(phone) = 12 THEN substr(phone, 3, 10) ELSE phone END AS contactPhone,
        lower({_GET['contactEmail']}) AS contactEmail, {_GET['website']} AS website, CASE WHEN doc_id % 12 = 3 THEN 'L12345RJ2001PLC123456' END AS cinNo,
        CASE WHEN doc_id % 12 = 3 THEN 'Plot 5, Station Road, Jaipur' WHEN doc_id % 12 = 4 THEN 'Road 7, Agra 282001, near the gate' END AS address,
        coalesce({_GET['pincode']}, CASE doc_id % 12 WHEN 3 THEN '302001' WHEN 4 THEN '282001' END) AS pincode FROM (SELECT *, regexp_replace({_GET['contactPhone']}, '[\\s\\-+()]', '', 'g') AS phone FROM company_cards)""",
    cards=CARDS,
    company_cards="""SELECT doc_id, text || CASE doc_id % 12 WHEN 3 THEN chr(10) || 'Regd. Office: Plot 5, Station Road, Jaipur - 302001' || chr(10) || 'cin l12345rj2001plc123456 https://www.alpha-cargo.co.in/rates'
        WHEN 4 THEN chr(10) || 'Head office - Road 7, Agra 282001, near the gate' ELSE '' END AS text FROM cards""",
)
def text_company(spark, d):
    """Some cards have an address with its pincode at the end or inside, a registration and a site."""
    k = F.col("doc_id") % 12
    office = F.lit("\nRegd. Office: Plot 5, Station Road, Jaipur - 302001\ncin l12345rj2001plc123456 https://www.alpha-cargo.co.in/rates")
    more = F.when(k == 3, office).when(k == 4, "\nHead office - Road 7, Agra 282001, near the gate").otherwise("")
    return op.text_company(cards(spark, d).withColumn("text", F.concat("text", more))).drop("text")


LINES = r"SELECT doc_id, i AS line_no, regexp_replace(l[i + 1], '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
CUT = r"""SELECT *, regexp_matches(line, '(?i)^---\s*Page\s+\d+') OR regexp_matches(line, '^[\-=_*~.]{4,}$') OR (line = '' AND coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no), 'x') = '')
    OR (line <> '' AND length(line) < 80 AND NOT regexp_matches(line, '[a-zß-ÿ]') AND len(string_split_regex(line, '\s+')) >= 2) AS cut FROM lines"""
BLOCKS = r"""SELECT doc_id, min(line_no) AS start_line, max(line_no) + 1 AS end_line, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\s+|\s+$', '', 'g') AS text
    FROM (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM cut) WHERE NOT cut GROUP BY doc_id, block"""


@query("segment_text", "SELECT doc_id, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, CAST(length(text) AS INT) AS chars FROM blocks WHERE length(text) >= 40", lines=LINES, cut=CUT, blocks=BLOCKS)
def segment_text(spark, d):
    return op.segment(spread(table(spark, d, "documents"))).select("doc_id", "start_line", "end_line", F.length("text").alias("chars"))


#: The documents with rate-card lines, each under a heading of its own after two blank lines.
HEADED = """SELECT doc_id, text || chr(10) || chr(10) || chr(10) || ['Air Freight Rates:', 'CHARGE DETAILS', 'zone matrix', 'Transit time', 'notes on the tariff', '* ODA *', 'Terms and conditions', 'general', 'divisor'][doc_id % 9 + 1] || chr(10)
    || ['quoted for the year and for all customers', 'delivery days 4 to 6 for every lane and station', '1 CFT = 8 kg for all lanes of this vendor', 'green tax of 35 for every docket and station', 'subject to the courts of the vendor alone'][doc_id % 5 + 1] AS text FROM cards"""


def headed(spark, d):
    k, lit = F.col("doc_id"), F.lit
    pick = lambda *xs: F.element_at(F.array(*map(lit, xs)), (k % len(xs) + 1).cast("int"))
    title = pick("Air Freight Rates:", "CHARGE DETAILS", "zone matrix", "Transit time", "notes on the tariff", "* ODA *", "Terms and conditions", "general", "divisor")
    body = pick("quoted for the year and for all customers", "delivery days 4 to 6 for every lane and station", "1 CFT = 8 kg for all lanes of this vendor", "green tax of 35 for every docket and station", "subject to the courts of the vendor alone")
    return cards(spark, d).select("doc_id", F.concat("text", lit("\n\n\n"), title, lit("\n"), body).alias("text"))


_TRIMMED = [f"coalesce(regexp_replace(string_split(text, chr(10))[{i}], '^\\s+|\\s+$', '', 'g'), '')" for i in (1, 2, 3)]
_HEAD_OF = lambda x: f"CASE WHEN {x} <> '' AND length({x}) <= 120 THEN CASE " + " ".join(f"WHEN regexp_matches({x}, '{_Q(p)}') THEN '{c}'" for c, p in op.HEADINGS) + " END END"
_INLINE = "CASE " + " ".join(f"WHEN regexp_matches(left(text, 300), '{_Q(p)}') THEN '{c}'" for c, p in op.INLINE_MARKERS) + " END"
BLOCK_KINDS = f"SELECT doc_id, start_line, coalesce({', '.join(map(_HEAD_OF, _TRIMMED))}) AS forced, {_INLINE} AS inl FROM blocks WHERE length(text) >= 40"
BLOCK_CLASSES = CLASSIFIED.replace("SELECT doc_id, CASE", "SELECT doc_id, start_line, CASE").replace("SELECT doc_id, -r", "SELECT doc_id, start_line, -r").replace("SELECT doc_id, list_sort", "SELECT doc_id, start_line, list_sort").replace("FROM cards", "FROM (SELECT doc_id, start_line, left(text, 2000) AS text FROM blocks WHERE length(text) >= 40)")


@query(
    "segment_categories",
    """SELECT doc_id, CAST(start_line AS INT) AS start_line, coalesce(forced, CASE WHEN inl IN ('VOLUMETRIC', 'LEGAL') OR (inl IS NOT NULL AND confidence < 0.55) THEN inl END, category) AS category,
        round(CASE WHEN forced IS NOT NULL THEN 0.95 WHEN inl IN ('VOLUMETRIC', 'LEGAL') THEN 0.88 WHEN inl IS NOT NULL AND confidence < 0.55 THEN 0.75 ELSE confidence END, 2) AS confidence
       FROM block_kinds JOIN block_classes USING (doc_id, start_line)""",
    cards=CARDS, headed=HEADED, lines=LINES.replace("FROM documents WHERE", "FROM headed WHERE"), cut=CUT, blocks=BLOCKS, block_kinds=BLOCK_KINDS, block_classes=BLOCK_CLASSES,
)
def segment_categories(spark, d):
    """Blocks of the documents with their categories by heading, phrase or classification."""
    found = op.categorize(op.segment(headed(spark, d)))
    return found.select("doc_id", "start_line", "category", F.round("confidence", 2).alias("confidence"))


SECTIONS = "SELECT doc_id, CAST(line_no AS INT) AS start_line, CAST(line_no + 1 AS INT) AS end_line, ['CHARGES', 'CHARGES', 'LEGAL', 'UNKNOWN'][length(line) % 4 + 1] AS category, (length(line) % 10) / 10 AS confidence FROM lines"


def _sections(spark, d):
    n = F.length("line")
    kinds = F.array(*map(F.lit, ["CHARGES", "CHARGES", "LEGAL", "UNKNOWN"]))
    return op.lines(table(spark, d, "documents")).select(
        "doc_id", F.col("line_no").alias("start_line"), (F.col("line_no") + 1).alias("end_line"), F.element_at(kinds, (n % 4 + 1).cast("int")).alias("category"), ((n % 10) / 10).alias("confidence")
    )


@query(
    "merge_sections",
    """SELECT doc_id, category, min(start_line) AS start_line, max(end_line) AS end_line, max(confidence) AS confidence, count(*) AS n_merged FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start_line) AS run FROM
       (SELECT *, CASE WHEN category <> 'UNKNOWN' AND confidence > 0.3 AND category = lag(category) OVER w AND lag(confidence) OVER w > 0.3 THEN 0 ELSE 1 END AS fresh FROM sections WINDOW w AS (PARTITION BY doc_id ORDER BY start_line))) GROUP BY doc_id, run, category""",
    lines=LINES, sections=SECTIONS,
)
def merge_sections(spark, d):
    return op.merge_sections(_sections(spark, d))


@query(
    "dangerous_sections",
    "SELECT doc_id, count(*) AS n, CAST(sum(start_line) AS BIGINT) AS s FROM (SELECT *, max(CASE WHEN category <> 'LEGAL' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS has_safe FROM sections) WHERE category <> 'LEGAL' OR has_safe = 0 GROUP BY doc_id",
    lines=LINES, sections=SECTIONS,
)
def dangerous_sections(spark, d):
    return op.safe_sections(_sections(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start_line").alias("s"))
