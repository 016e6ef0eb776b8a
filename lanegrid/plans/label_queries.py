"""Queries of labels, learning, streams and sources, and their DuckDB twins."""

from __future__ import annotations


from pyspark.sql import functions as F

from lanegrid.operators import labels as op
from lanegrid.operators import rates as rate_op
from lanegrid.plans.fixtures import rates, sql
from lanegrid.plans.rate_queries import MATRIX
from lanegrid.runtime import Scratch, table
from lanegrid.sources import files
from lanegrid.streaming import learning

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None, **views: str):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle, **views)
        return f

    return register


def _null(x):
    return "NULL" if x is None else f"'{x}'"


_KEYS = list(op.CHARGE_LABELS)
_KEY_SQL = "[" + ", ".join(f"'{k}'" for k in _KEYS) + "]"
#: Labels from ``part``: dictionary labels, with noise, cut short, with more words, or misspelt, beside the parts' names.
LABELS = f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN upper(k) WHEN 1 THEN k || ' (India)' WHEN 2 THEN left(k, CAST(length(k) - 1 AS INT)) WHEN 3 THEN k || ' per kg' WHEN 4 THEN replace(k, 'ar', 'ra') ELSE p_name END AS label
    FROM (SELECT *, {_KEY_SQL}[p_size % {len(_KEYS)} + 1] AS k FROM part)"""


def labels(spark, d):
    n = F.col("p_partkey") % 6
    k = F.element_at(F.array(*map(F.lit, _KEYS)), (F.col("p_size") % len(_KEYS) + 1).cast("int"))
    label = (
        F.when(n == 0, F.upper(k)).when(n == 1, F.concat(k, F.lit(" (India)"))).when(n == 2, F.left(k, F.length(k) - 1)).when(n == 3, F.concat(k, F.lit(" per kg"))).when(n == 4, F.replace(k, F.lit("ar"), F.lit("ra"))).otherwise(F.col("p_name"))
    )
    return table(spark, d, "part").select("p_partkey", label.alias("label"))


_NORM = "trim(regexp_replace(regexp_replace(lower(label), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"
_NOISE = "[" + ", ".join(f"'{w}'" for w in op.NOISE) + "]"
NORMED = f"SELECT *, {_NORM} AS n FROM labels"


@query(
    "normalise_label",
    f"""SELECT p_partkey, n, CASE WHEN len(rest) > 0 THEN array_to_string(rest, ' ') ELSE n END AS plain, CAST(len(list_distinct(list_filter(string_split(n, ' '), lambda w: length(w) >= 2))) AS INT) AS n_tokens
        FROM (SELECT *, list_filter(string_split(n, ' '), lambda w: NOT list_contains({_NOISE}, w)) AS rest FROM normed)""",
    labels=LABELS, normed=NORMED,
)
def normalise_label(spark, d):
    n = op.normalise(F.col("label"))
    return labels(spark, d).select("p_partkey", n.alias("n"), op.strip_noise(n).alias("plain"), F.size(op.tokens(n)).alias("n_tokens"))


@query(
    "label_match_exact",
    f"""SELECT DISTINCT label, coalesce(a.value, b.value) AS value, CASE WHEN a.value IS NOT NULL THEN 'exact' ELSE 'normalised' END AS method
        FROM (SELECT label, n, array_to_string(list_filter(string_split(n, ' '), lambda w: NOT list_contains({_NOISE}, w)), ' ') AS plain FROM normed) LEFT JOIN known a ON a.known = n LEFT JOIN known b ON b.known = plain WHERE coalesce(a.value, b.value) IS NOT NULL""",
    labels=LABELS, normed=NORMED, known="SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in op.CHARGE_LABELS.items() if v) + ") t(known, value)",
)
def label_match_exact(spark, d):
    return op.match(labels(spark, d), op.dictionary(spark)).where("method in ('exact', 'normalised')").select("label", "value", "method")


_TOKENS = lambda c: f"list_distinct(list_filter(string_split({c}, ' '), lambda w: length(w) >= 2))"
LAYERS = f"""SELECT label, ord, value, common, CASE WHEN n = known THEN 1 WHEN plain = known THEN 2 WHEN n <> '' AND (contains(n, known) OR contains(known, n)) AND least(length(n), length(known)) / greatest(length(n), length(known), 1) >= 0.7 THEN 3 WHEN common >= 0.7 THEN 4 END AS layer
    FROM (SELECT l.*, k.*, len(list_intersect({_TOKENS("n")}, {_TOKENS("known")})) / greatest(len({_TOKENS("n")}), len({_TOKENS("known")}), 1) AS common FROM (SELECT DISTINCT label, n, CASE WHEN len(rest) > 0 THEN array_to_string(rest, ' ') ELSE n END AS plain
      FROM (SELECT *, list_filter(string_split(n, ' '), lambda w: NOT list_contains({_NOISE}, w)) AS rest FROM normed)) l CROSS JOIN (VALUES {", ".join(f"({i}, '{k}', {_null(v)})" for i, (k, v) in enumerate(op.CHARGE_LABELS.items()))}) k(ord, known, value))"""


@query(
    "label_match_layers",
    """SELECT label, b.value AS value, [1.0, 0.95, 0.85, 0.75][b.layer] AS confidence, ['exact', 'normalised', 'substring', 'token'][b.layer] AS method FROM (SELECT label, arg_min({'value': value, 'layer': layer}, (layer, CASE WHEN layer = 4 THEN -common ELSE 0 END, ord)) AS b FROM layers WHERE layer IS NOT NULL GROUP BY label) WHERE b.value IS NOT NULL""",
    labels=LABELS, normed=NORMED, layers=LAYERS,
)
def label_match_layers(spark, d):
    """All layers of the match but the one by spelling."""
    return op.match(labels(spark, d), op.dictionary(spark)).where("method <> 'fuzzy'")


@query("label_match", None)
def label_match(spark, d):
    return op.match(labels(spark, d), op.dictionary(spark))


CELLS = "SELECT p_partkey, [p_brand, p_brand, p_type, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END, p_name] AS c FROM part"


@query("dedupe_adjacent_cells", "SELECT p_partkey, array_to_string(list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]), '|') AS cells FROM cells", cells=CELLS)
def dedupe_adjacent_cells(spark, d):
    cells = F.array("p_brand", "p_brand", "p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.col("p_name")), "p_name")
    return table(spark, d, "part").withColumn("c", cells).select("p_partkey", F.array_join(op.dedupe_adjacent(F.col("c")), "|").alias("cells"))


#: Learning events from ``events``: 40 labels and two meanings each.
LEARN = "SELECT CASE WHEN user_id % 2 = 0 THEN 'charge' ELSE 'zone' END AS type, 'raw' || (user_id % 40) AS raw, 'm' || (event_id % 2) AS canonical, ['confirm', 'passive', 'wrong', 'passive', 'taught', 'confirm', 'wrong'][event_id % 7 + 1] AS kind, ts, event_id AS seq FROM events"


def learn_events(rows):
    u, e = F.col("user_id"), F.col("event_id")
    kinds = F.array(*map(F.lit, ["confirm", "passive", "wrong", "passive", "taught", "confirm", "wrong"]))
    return rows.select(
        F.when(u % 2 == 0, "charge").otherwise("zone").alias("type"),
        F.concat(F.lit("raw"), (u % 40).cast("string")).alias("raw"),
        F.concat(F.lit("m"), (e % 2).cast("string")).alias("canonical"),
        F.element_at(kinds, (e % 7 + 1).cast("int")).alias("kind"),
        "ts",
        e.alias("seq"),
        *[c for c in ("part",) if c in rows.columns],
    )


_NEXT_C = "CASE e.kind WHEN 'confirm' THEN least(0.99, coalesce(w.c, 0.5) + (1 - coalesce(w.c, 0.5)) * 0.35) WHEN 'passive' THEN least(0.95, coalesce(w.c, 0.4) + (1 - coalesce(w.c, 0.4)) * 0.15) WHEN 'taught' THEN least(0.99, coalesce(w.c, 0.5) + 0.4) ELSE w.c * 0.5 END"
_NEXT_N = "w.n + CASE WHEN e.kind IN ('confirm', 'taught') THEN 1.0 WHEN e.kind = 'passive' THEN 0.5 ELSE 0.0 END"
STATE = f"""SELECT type, raw, canonical, n AS confirmations, corrections, c AS confidence, promoted FROM (
    WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY type, raw, canonical ORDER BY ts, seq) AS i, count(*) OVER (PARTITION BY type, raw, canonical) AS last FROM learn),
    walk AS (SELECT DISTINCT type, raw, canonical, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS n, CAST(0 AS INT) AS corrections, CAST(NULL AS DOUBLE) AS c, FALSE AS promoted, last FROM numbered
      UNION ALL SELECT w.type, w.raw, w.canonical, e.i, CAST({_NEXT_N} AS DOUBLE), CAST(w.corrections + CASE WHEN e.kind = 'wrong' AND w.c IS NOT NULL THEN 1 ELSE 0 END AS INT), CAST({_NEXT_C} AS DOUBLE),
        w.promoted OR e.kind = 'taught' OR ({_NEXT_C} >= 0.8 AND ((e.kind = 'confirm' AND {_NEXT_N} >= 3) OR (e.kind = 'passive' AND {_NEXT_N} >= 6))), w.last
      FROM walk w JOIN numbered e ON e.type = w.type AND e.raw = w.raw AND e.canonical = w.canonical AND e.i = w.i + 1)
    SELECT * FROM walk WHERE i = last) WHERE c IS NOT NULL"""


def _state(spark, d):
    return op.fold_events(learn_events(table(spark, d, "events")))


@query("learning_fold", "SELECT type, raw, canonical, confirmations, corrections, round(confidence, 9) AS confidence, promoted FROM state", learn=LEARN, state=STATE)
def learning_fold(spark, d):
    return _state(spark, d).withColumn("confidence", F.round("confidence", 9))


@query("best_suggestion", "SELECT type, raw, arg_min(canonical, (-confidence, canonical)) AS canonical, round(max(confidence), 9) AS confidence FROM state WHERE confidence >= 0.7 GROUP BY ALL", learn=LEARN, state=STATE)
def best_suggestion(spark, d):
    return op.best_suggestion(_state(spark, d)).withColumn("confidence", F.round("confidence", 9))


@query("learning_stats", "SELECT type, count(*) AS n, CAST(sum(CASE WHEN promoted THEN 1 ELSE 0 END) AS BIGINT) AS promoted, round(avg(confidence), 3) AS confidence FROM state GROUP BY type", learn=LEARN, state=STATE)
def learning_stats(spark, d):
    return op.learning_stats(_state(spark, d))


@query("topk_learned", "SELECT type, raw, canonical, confirmations FROM state WHERE promoted ORDER BY confirmations DESC, type, raw, canonical LIMIT 20", learn=LEARN, state=STATE)
def topk_learned(spark, d):
    """The twenty promoted entries with most confirmations."""
    return _state(spark, d).where("promoted").orderBy(F.desc("confirmations"), "type", "raw", "canonical").limit(20).select("type", "raw", "canonical", "confirmations")


@query("topk_event_kinds", "SELECT kind, count(*) AS n FROM learn GROUP BY kind ORDER BY n DESC, kind LIMIT 5", learn=LEARN)
def topk_event_kinds(spark, d):
    return learn_events(table(spark, d, "events")).groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(5)


@query("last_events", "SELECT type, raw, canonical, kind, seq FROM learn ORDER BY ts DESC, seq DESC LIMIT 5", learn=LEARN)
def last_events(spark, d):
    return learn_events(table(spark, d, "events")).orderBy(F.desc("ts"), F.desc("seq")).limit(5).select("type", "raw", "canonical", "kind", "seq")


@query("topk_uncertain", "SELECT type, raw, canonical, round(confidence, 9) AS confidence FROM state WHERE confidence < 0.8 ORDER BY round(confidence, 9), type, raw, canonical LIMIT 20", learn=LEARN, state=STATE)
def topk_uncertain(spark, d):
    """The twenty entries of least confidence under 0.8."""
    rows = _state(spark, d).withColumn("confidence", F.round("confidence", 9)).where("confidence < 0.8")
    return rows.orderBy("confidence", "type", "raw", "canonical").limit(20).select("type", "raw", "canonical", "confidence")


@query("stream_learning_state", "SELECT type, raw, canonical, confirmations, corrections, round(confidence, 9) AS confidence, promoted FROM state", learn=LEARN, state=STATE)
def stream_learning_state(spark, d):
    """Events land in files of ten days each, but every third event in the file after its own, and are folded as a stream, a file a batch, by their times."""
    root = Scratch(spark).root
    day = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 864000)
    rows = table(spark, d, "events").withColumn("part", day + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0))
    events = learn_events(rows)
    for part in sorted(r[0] for r in events.select("part").distinct().collect()):
        events.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{root}/landing/{part}")
    schema = events.drop("part").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{root}/landing")
    learning.write_states(stream, f"{root}/states", f"{root}/stream", late="21 days").awaitTermination()
    return learning.last_states(spark, f"{root}/states").withColumn("confidence", F.round("confidence", 9))


COMPANIES = {"alpha": (["the", "hea"], "ering", None, "onth"), "beta": (["idiot", "clown"], None, "ation", None), "gamma": (["der", "die"], None, None, None), "delta": (["los", "que"], "ción", "ment", "tion")}
_COMPANY = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {a}, {_null(g)}, {_null(p)}, {_null(e)})" for c, (a, g, p, e) in COMPANIES.items()) + ") t(company, aliases, gst, phone, email)"
FOUND = """SELECT doc_id, arg_min(company, (-score, company)) AS company, CAST(max(score) AS DOUBLE) AS score FROM (SELECT doc_id, company, round(least(0.99, len(list_filter(aliases, lambda a: contains(low, a))) * 0.4 + CASE WHEN contains(folder, company) OR len(list_filter(aliases, lambda a: contains(folder, a))) > 0 THEN 0.3 ELSE 0 END
      + CASE WHEN contains(low, gst) THEN 0.5 ELSE 0 END + CASE WHEN contains(low, phone) THEN 0.3 ELSE 0 END + CASE WHEN contains(low, email) THEN 0.3 ELSE 0 END), 2) AS score
    FROM (SELECT doc_id, lower(coalesce(text, '')) AS low, CASE WHEN source = 'src1' THEN 'alpha files' ELSE 'other' END AS folder FROM documents) CROSS JOIN companies) WHERE score > 0 GROUP BY doc_id"""


def _found(spark, d):
    companies = spark.createDataFrame([(c, *v) for c, v in COMPANIES.items()], "company string, aliases array<string>, gst string, phone string, email string").coalesce(1)
    rows = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("source") == "src1", "ALPHA files").otherwise("other").alias("folder"))
    return op.classify_company(rows, companies)


@query("company_classify", "SELECT doc_id, company, score FROM found", companies=_COMPANY, found=FOUND)
def company_classify(spark, d):
    return _found(spark, d)


@query(
    "charge_suggestions",
    "SELECT doc_id, f.company, r.field, r.value, FALSE AS applied FROM found f JOIN reference r ON r.company = f.company WHERE score >= 0.65 AND NOT (doc_id % 2 = 0 AND r.field = 'fuel')",
    companies=_COMPANY, found=FOUND, reference="SELECT * FROM (VALUES ('alpha', 'fuel', 20.0::DOUBLE), ('alpha', 'docketCharges', 75.0::DOUBLE), ('gamma', 'fuel', 18.0::DOUBLE), ('delta', 'greenTax', 100.0::DOUBLE)) t(company, field, value)",
)
def charge_suggestions(spark, d):
    reference = spark.createDataFrame([("alpha", "fuel", 20.0), ("alpha", "docketCharges", 75.0), ("gamma", "fuel", 18.0), ("delta", "greenTax", 100.0)], "company string, field string, value double").coalesce(1)
    present = table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit("fuel").alias("field"))
    return op.charge_suggestions(_found(spark, d), present, reference)


# ---- sources and sinks ----------------------------------------------------------------------


@query(
    "scan_vendor_json",
    "SELECT s_suppkey AS vendor_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN '29ABCDE1234F1Z5' END AS gstNo, CAST(s_nationkey AS DOUBLE) AS fuel FROM supplier",
)
def scan_vendor_json(spark, d):
    """Half of the vendors' pieces are wrapped, half flat; they are written as JSON and read back."""
    path = f"{Scratch(spark).root}/pieces"
    k = F.col("s_suppkey")
    gst = F.when(k % 2 == 0, "29ABCDE1234F1Z5")
    inner = F.struct(F.col("s_name").alias("name"), gst.alias("gstNo"))
    charges = F.create_map(F.lit("fuel"), F.col("s_nationkey").cast("double"))
    rows = table(spark, d, "supplier").select(
        k.alias("vendor_id"), F.when(k % 3 == 0, inner).alias("company_details"), F.when(k % 3 == 1, inner).alias("company"), F.when(k % 3 == 2, F.col("s_name")).alias("name"), F.when(k % 3 == 2, gst).alias("gstNo"),
        F.when(k % 2 == 0, charges).alias("charges"), F.when(k % 2 == 1, charges).alias("pricing"),
    )
    rows.write.json(path)
    return files.read_pieces(spark, path).select("vendor_id", "name", "gstNo", F.col("charges")["fuel"].alias("fuel"))


@query(
    "scan_delimited_grid",
    """SELECT s_suppkey % 7 AS sheet, CAST(s_suppkey AS VARCHAR) AS a, CASE s_suppkey % 4 WHEN 0 THEN s_name || ', Pune' WHEN 1 THEN 'two' || chr(10) || 'lines, "quoted"' WHEN 2 THEN s_name || ' 5" pipe' ELSE 'Café ' || s_name END AS b, CAST(s_nationkey AS VARCHAR) AS c FROM supplier""",
)
def scan_delimited_grid(spark, d):
    """Suppliers written as files of tabs or commas, in UTF-8 or Latin-1, with blank rows and quoted separators, line breaks and quotes, and read back as a grid."""
    path = f"{Scratch(spark).root}/grid"
    k = F.col("s_suppkey")
    sheet = k % 7
    tab = sheet % 2 == 0
    mark = F.when(tab, F.lit("\t")).otherwise(F.lit(","))
    name = (
        F.when(k % 4 == 0, F.concat(F.lit('"'), "s_name", F.lit(', Pune"'))).when(k % 4 == 1, F.lit('"two\nlines, ""quoted"""'))
        .when(k % 4 == 2, F.concat("s_name", F.lit(' 5" pipe'))).otherwise(F.concat(F.lit("Café "), "s_name"))
    )
    line = F.concat(k.cast("string"), F.lit(".0"), mark, name, mark, F.col("s_nationkey").cast("string"), F.lit("\n"), mark, mark)
    coded = F.when(sheet >= 4, F.encode(line, "ISO-8859-1")).otherwise(F.encode(line, "UTF-8")).cast("string")
    rows = table(spark, d, "supplier").select(sheet.alias("sheet"), coded.alias("value"))
    for separator, some in (("\t", tab), (",", ~tab)):
        rows.where(some).repartition("sheet").write.mode("append").partitionBy("sheet").text(f"{path}/{'tab' if separator == chr(9) else 'comma'}")
    grid = files.read_grid(spark, f"{path}/tab/*/*.txt", "\t").unionByName(files.read_grid(spark, f"{path}/comma/*/*.txt"))
    return grid.select(F.regexp_extract("file", r"sheet=(\d+)", 1).cast("long").alias("sheet"), *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate("abc")])


@query(
    "scan_sheet_grid",
    "SELECT s_suppkey % 5 AS sheet, count(*) AS n_rows, CAST(sum(CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 2 END) AS BIGINT) AS n_cells FROM supplier GROUP BY ALL",
)
def scan_sheet_grid(spark, d):
    """A table of exported sheets: cells trimmed, empty rows dropped, empty cells kept out of the count."""
    k = F.col("s_suppkey")
    cells = F.array(F.concat(F.lit(" "), k, F.lit(".0")), F.col("s_name"), F.when(k % 2 == 0, "x").otherwise("  "))
    rows = table(spark, d, "supplier").select((k % 5).alias("sheet"), F.transform(cells, files.cell_text).alias("cells"))
    filled = rows.select("sheet", F.size(F.filter("cells", lambda c: c != "")).alias("n")).where("n > 0")
    return filled.groupBy("sheet").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_cells"))


@query("list_source_files", "SELECT 'csv' AS extension, count(DISTINCT s_suppkey % 6) AS files FROM supplier")
def list_source_files(spark, d):
    """Suppliers written as CSV folders; writers' markers and checksums are hidden names."""
    path = f"{Scratch(spark).root}/files"
    table(spark, d, "supplier").select((F.col("s_suppkey") % 6).alias("part"), "s_name").repartition("part").write.partitionBy("part").csv(path)
    return files.list_files(spark, path).groupBy("extension").agg(F.count_distinct(F.regexp_extract("file", r"part=(\d+)", 1)).alias("files"))


@query("text_to_grid", r"SELECT doc_id, CAST(i AS INT) AS row_idx, CAST(len(c) AS INT) AS n, c[1] AS first FROM (SELECT doc_id, i, list_filter(list_transform(string_split_regex(line, '\t| {2,}|\|'), lambda x: trim(x)), lambda x: x <> '') AS c FROM (SELECT doc_id, i, l[i + 1] AS line FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))) WHERE trim(line) <> '' AND NOT starts_with(trim(line), '---')) WHERE len(c) > 0")
def text_to_grid(spark, d):
    return files.text_grid(table(spark, d, "documents")).select("doc_id", "row_idx", F.size("cells").alias("n"), F.get("cells", F.lit(0)).alias("first"))


@query("write_documents", "SELECT CAST(vendor_id AS INT) AS vendor_id, origin, count(*) AS n, round(sum(rate), 2) AS total FROM matrix GROUP BY vendor_id, origin", matrix=MATRIX)
def write_documents(spark, d):
    """Vendors' matrices written as JSON documents and read back."""
    path = f"{Scratch(spark).root}/documents"
    matrix = rate_op.pick_rate(rates(spark, d), 5.0, inclusive=True)
    files.write_documents(matrix.groupBy("vendor_id", "origin").agg(F.map_from_entries(F.collect_list(F.struct("dest", "rate"))).alias("rates")), path)
    read = spark.read.schema("origin string, rates map<string,double>, vendor_id int").json(path)
    return read.select("vendor_id", "origin", F.explode("rates").alias("dest", "rate")).groupBy("vendor_id", "origin").agg(F.count("*").alias("n"), F.round(F.sum("rate"), 2).alias("total"))


@query("stream_rate_ingest", "SELECT CAST(vendor_id AS INT) AS vendor_id, origin, dest, rate FROM matrix", matrix=MATRIX)
def stream_rate_ingest(spark, d):
    """Rate samples land as files and are ingested as a stream, two files a batch; the batches' parts are merged."""
    root = Scratch(spark).root
    rates(spark, d).select("vendor_id", "origin", "dest", "rate").repartition(4).write.parquet(f"{root}/landing")
    stream = spark.readStream.schema("vendor_id int, origin string, dest string, rate double").option("maxFilesPerTrigger", 2).parquet(f"{root}/landing")
    learning.ingest_rates(stream, f"{root}/out", f"{root}/ingest").awaitTermination()
    return learning.ingested_matrix(spark, f"{root}/out")
