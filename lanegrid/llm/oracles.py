"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

SPACE_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
PLAIN_WORDS = (
    r"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
LOWER_WORDS = (
    r"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
)

OP2_HITS = f"""
d AS (SELECT doc_id, {PLAIN_WORDS.format(text="text")} AS w FROM {{documents}}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {PLAIN_WORDS.format(text="text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS content
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS content
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, dw.i, dw.size, item_id FROM dw JOIN bw USING (size, content))
"""

OP2 = f"""
WITH {OP2_HITS.format(documents="documents")},
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS listed FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_ESCAPED = "coalesce({c}, '')"
for _from, _to in (("\\", "\\\\"), ("[/INST]", "[\\/INST]"), ("[INST]", "[\\INST]"), ("</s>", "<\\/s>"), ("<s>", "<\\s>")):
    _ESCAPED = f"replace({_ESCAPED}, '{_from}', '{_to}')"

OP10 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(20 + length({_ESCAPED.format(c="role")}) + length({_ESCAPED.format(c="text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def mixing_sql(documents: str, weights: dict[str, dict[str, int]], up: int, down: int, epochs: int, seed: int) -> str:
    """CTEs ending in ``mixture`` (doc_id, domain, lang, source, n_tokens, epoch)."""
    parts = [
        f"""sized AS (SELECT DISTINCT doc_id, text, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
            coalesce('domain' || (TRY_CAST(regexp_extract(source, '[0-9]+$') AS INT) % 3), '(none)') AS domain,
            CAST(len({SPACE_WORDS.format(text="text")}) AS BIGINT) AS n_tokens FROM {documents})""",
        f"leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {epochs} AS capacity FROM sized GROUP BY ALL)",
        f"level0 AS (SELECT coalesce(sum(tokens) * {up} // {down}, 0) AS budget FROM leaves)",
    ]
    levels = ("domain", "lang", "source")
    for i, level in enumerate(levels):
        keys, parent = ", ".join(levels[: i + 1]), ", ".join(levels[:i])
        weight = f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.get(level, {}).items()) + " ELSE 1 END" if weights.get(level) else "1"
        join = f"JOIN level{i} USING ({parent})" if parent else "CROSS JOIN level0"
        by = f"PARTITION BY {parent} " if parent else ""
        parts += [
            f"n{i} AS (SELECT *, {weight} AS weight FROM (SELECT {keys}, sum(capacity) AS capacity FROM leaves GROUP BY ALL) {join})",
            f"""f{i} AS (SELECT *, weight > 0 AND capacity * after <= weight * greatest(budget - before, 0) AS filled FROM (SELECT *,
                coalesce(sum(capacity) OVER ({by}ORDER BY capacity / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                sum(weight) OVER ({by}ORDER BY capacity / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM n{i}))""",
            f"""g{i} AS (SELECT *, budget - coalesce(sum(capacity) FILTER (WHERE filled) OVER ({by}), 0) AS remaining,
                sum(weight) FILTER (WHERE NOT filled) OVER ({by}) AS others FROM f{i})""",
            f"level{i + 1} AS (SELECT {keys}, CASE WHEN filled THEN capacity WHEN others > 0 THEN weight * remaining // others ELSE 0 END AS budget FROM g{i})",
        ]
    parts += [
        "plan AS (SELECT *, budget // tokens AS whole, budget % tokens AS rest FROM leaves JOIN level3 USING (domain, lang, source) WHERE budget > 0 AND tokens > 0)",
        "placed AS (SELECT * FROM sized JOIN plan USING (domain, lang, source))",
        f"""ranked AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed WHERE rest > 0)""",
        """mixture AS (SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(0, CAST(whole AS BIGINT))) AS INT) AS epoch FROM placed
            UNION ALL SELECT doc_id, domain, lang, source, n_tokens, CAST(whole AS INT) FROM ranked WHERE upto <= rest)""",
    ]
    return ",\n".join(parts)


WEIGHTS = {
    "domain": {"domain0": 5, "domain1": 3, "domain2": 2},
    "lang": {"en": 6, "de": 2, "fr": 2, "es": 2},
}
OP4 = f"WITH {mixing_sql('documents', WEIGHTS, 3, 5, 2, 11)} SELECT doc_id, domain, lang, source, n_tokens, epoch FROM mixture"

OP5_COMPONENTS = f"""
d AS (SELECT doc_id, {LOWER_WORDS.format(text="text")} AS w FROM {{documents}}),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g
      FROM (SELECT doc_id, w, least(len(w), 5) AS k, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e2 AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT x AS doc_id, x AS other FROM e2 UNION SELECT reach.doc_id, e2.y FROM reach JOIN e2 ON reach.other = e2.x)
"""

OP5 = f"""
WITH RECURSIVE {OP5_COMPONENTS.format(documents="documents")}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least(d.doc_id, r.m), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) r USING (doc_id)
"""

#: Lines of ``documents``, the shortest run from each with 20 words, and the lines of later copies.
OP3_LINES = r"""
arr AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {documents} WHERE text IS NOT NULL),
ln AS (SELECT doc_id, i, lines[i] AS line, len(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+')) AS n
       FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM arr)),
cum AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM ln),
unit AS (SELECT a.doc_id, a.i, min(b.i) AS e FROM cum a JOIN cum b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 20 GROUP BY ALL),
named AS (SELECT doc_id, i, e, row_number() OVER (PARTITION BY array_to_string(lines[i:e], chr(10)), e - i ORDER BY doc_id, i) AS copy FROM unit JOIN arr USING (doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, e + 1)) AS i FROM named WHERE copy > 1),
kept AS (SELECT ln.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
                coalesce(string_agg(line, chr(10) ORDER BY ln.i) FILTER (WHERE gone.i IS NULL), '') AS text
         FROM ln LEFT JOIN gone ON ln.doc_id = gone.doc_id AND ln.i = gone.i GROUP BY ln.doc_id)
"""

OP3 = f"""
WITH {OP3_LINES.format(documents="documents")}
SELECT doc_id, CAST(coalesce(n_lines, 0) AS INT) AS n_lines, CAST(coalesce(n_removed, 0) AS INT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

#: Unsigned crc32 of a text: the usual table, made by eight steps per entry, folded over the bytes (decimal numbers: one per character).
CRC_TABLE = "crc_table AS (SELECT list(e ORDER BY i) AS crcs FROM (SELECT i, {steps} AS e FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)))"
_steps = "i"
for _ in range(8):
    _steps = f"list_transform([{_steps}], lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)[1]"
CRC_TABLE = CRC_TABLE.format(steps=_steps)
CRC = (
    "xor(list_reduce(list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), "
    "lambda acc, b: xor(acc >> 8, crcs[(xor(acc, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
)


def merkle_sql(levels: int = 8) -> str:
    """The manifest of ``documents``: leaves, then level by level for the languages' trees (of up to 8 ** ``levels`` leaves) and the tree over them."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        CRC_TABLE,
        f"""hashed AS (SELECT doc_id, lang, coalesce('=' || lang, '') AS tree, {leaf("text")} AS leaf,
            CASE WHEN {CRC.format(c="doc_id")} % 3 = 0 THEN {leaf(lowered)} END AS altered FROM documents, crc_table)""",
        "docs AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM hashed)",
        "a0 AS (SELECT tree, k, leaf AS digest FROM docs)",
    ]

    def climb(name: str) -> None:
        for h in range(levels):
            rest = f"(SELECT *, count(*) OVER (PARTITION BY tree) > 1 AS more FROM {name}{h})"
            parts.append(
                f"""{name}{h + 1} AS (SELECT tree, k // 8 AS k, sha256(string_agg(digest, '' ORDER BY k)) AS digest FROM {rest} WHERE more GROUP BY tree, k // 8
                UNION ALL SELECT tree, k, digest FROM {rest} WHERE NOT more)"""
            )

    climb("a")
    parts.append(f"b0 AS (SELECT 'all' AS tree, row_number() OVER (ORDER BY tree) - 1 AS k, digest, tree AS own FROM a{levels})")
    climb("b")

    def prove(name: str, rows: str, start: str, tree: str) -> str:
        """Siblings to the left and right of ``pos`` on every level where the tree has more than one node."""
        for h in range(levels):
            size, side = f"(SELECT tree, count(*) AS n FROM {name}{h} GROUP BY tree)", f"{rows}{h}"
            near = lambda op: f"(SELECT coalesce(string_agg(x.digest, '' ORDER BY x.k), '') FROM {name}{h} x WHERE x.tree = p.{tree} AND x.k // 8 = p.pos // 8 AND x.k {op} p.pos)"  # noqa: B023, E731
            parts.append(
                f"""{side} AS (SELECT p.* EXCLUDE (pos, joined, folded), CASE WHEN z.n > 1 THEN pos // 8 ELSE pos END AS pos,
                CASE WHEN z.n > 1 THEN joined || {near("<")} || {near(">")} ELSE joined END AS joined,
                CASE WHEN z.n > 1 THEN sha256({near("<")} || folded || {near(">")}) ELSE folded END AS folded
                FROM {start if h == 0 else f"{rows}{h - 1}"} p JOIN {size} z ON z.tree = p.{tree})"""
            )
        return f"{rows}{levels - 1}"

    parts.append("start AS (SELECT doc_id, tree, 'all' AS everything, leaf, k AS pos, '' AS joined, coalesce(altered, leaf) AS folded FROM docs)")
    first = prove("a", "p", "start", "tree")
    parts.append(f"middle AS (SELECT m.* EXCLUDE (pos), b0.k AS pos, b0.digest AS subroot FROM {first} m JOIN b0 ON b0.own = m.tree)")
    last = prove("b", "q", "middle", "everything")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, r.digest AS root, sha256(joined) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified FROM {last}, b{levels} r"""


OP11 = merkle_sql()

OP13 = f"""
WITH {CRC_TABLE},
t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {CRC.format(c="conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), crc_table),
r AS (SELECT c.conv_id, k, name, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND k < h
      UNION ALL SELECT conv_id, k, name, text FROM c JOIN t USING (conv_id) WHERE k >= h),
s AS (SELECT conv_id, count(*) OVER w AS d, string_agg(name, '') OVER w AS path, length(text) AS chars, count(*) OVER (PARTITION BY conv_id) AS turns
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY k)
      UNION ALL SELECT conv_id, 0, '', 0, coalesce(turns, 0) FROM c LEFT JOIN (SELECT conv_id, count(*) AS turns FROM r GROUP BY conv_id) USING (conv_id)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE turns = d) AS ends FROM s GROUP BY path, d),
kids AS (SELECT path[1:64 * (d - 1)] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (path)),
sums AS (SELECT path[1:64 * above] AS path, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS above FROM m) GROUP BY ALL)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN sums USING (path) LEFT JOIN m p ON m.d > 0 AND p.path = m.path[1:64 * (m.d - 1)]
"""
