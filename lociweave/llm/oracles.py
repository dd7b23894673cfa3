"""DuckDB statements for the text queries that SQL can express."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh
  FROM d
), u AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n, unnest(sh) AS g FROM s),
e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS c FROM s UNION SELECT r.x, e.y FROM reach r JOIN e ON r.c = e.x
), m AS (SELECT x, min(c) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN m ON m.x = s.doc_id
"""


def _secret_spans() -> str:
    from lociweave.llm import secret_scan as s

    def spans(pattern: str, kind: int, test: str) -> str:
        """kind, start and stop of the matches of a pattern that pass ``test`` on (m, g2)."""
        p = pattern.replace("'", "''")
        return f"""
  SELECT doc_id, {kind} AS kind, m, g2, a AS start, a + length(m) AS stop FROM (
    SELECT doc_id, m, g2, CAST(sum(length(piece) + length(coalesce(before, ''))) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS a FROM (
      SELECT doc_id, i, m, g2, piece, lag(m) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (
        SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs) AS g2, unnest(ps[1:len(ms)]) AS piece FROM (
          SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {2 if kind == 0 else 0}) AS gs, string_split_regex(t, '{p}') AS ps FROM d))))
  WHERE {test}"""

    terms = "[" + ", ".join(map(str, s.TERMS)) + "]"
    allowed = " OR ".join(f"regexp_matches(m, '{p}')" for p in s.ALLOW)
    hexed = f"regexp_matches(m, '{s.HEX_RUN}')"
    most = f"CASE WHEN {hexed} THEN {s.most_weight(s.LIMIT_BITS['entropy_hex'])} ELSE {s.most_weight(s.LIMIT_BITS['entropy_mixed'])} END"
    window = f"list_sum(list_transform(list_distinct(string_split(m[j:j + {s.WINDOW - 1}], '')), lambda c: {terms}[1 + length(m[j:j + {s.WINDOW - 1}]) - length(replace(m[j:j + {s.WINDOW - 1}], c, ''))]))"
    lowest = f"list_min(list_transform(range(1, length(m) - {s.WINDOW - 2}), lambda j: {window}))"
    kinds = "['" + "', '".join(s.KINDS) + "']"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({spans(s.ASSIGN, 0, "length(g2) >= 8")} UNION ALL {spans(s.ACCESS, 1, "true")} UNION ALL {spans(s.HEX, 2, "true")}),
more AS (SELECT doc_id, CASE WHEN {hexed} THEN 3 ELSE 4 END AS kind, m, g2, start, stop FROM ({spans(s.RUN, 3, "true")}) WHERE NOT ({allowed}) AND {lowest} <= {most}),
b AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg({kinds}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS base FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg({kinds}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS spans
  FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""


def _crc32(blob: str) -> str:
    """The usual checksum of a blob, byte by byte through a table that is built from the polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    bytes_of = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda p: CAST('0x' || p AS BIGINT))"
    return f"xor(list_reduce({bytes_of}, lambda acc, b: xor(acc >> 8, list_extract({table}, 1 + (xor(acc, b) & 255))), 4294967295), 4294967295)"


def _hilbert() -> str:
    from lociweave.llm import hilbert as h

    top = h.BITS - 1
    levels = []
    for i, c in enumerate(h.CATEGORIES):
        chosen = f"SELECT v, row_number() OVER (ORDER BY v) AS place FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY v ORDER BY n DESC, v LIMIT {2**h.BITS - 2})"
        levels.append(f"l{i} AS ({chosen})")
    measured = f"""sized AS (SELECT *, coalesce(octet_length(encode(text)), 0) + 1 AS size, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {_crc32("encode(text)")} END AS text_crc32 FROM documents),
rows_ AS (SELECT doc_id, size, text_crc32, CASE WHEN lang IS NULL THEN 0 ELSE coalesce(l0.place, {2**h.BITS - 1}) END AS x0, CASE WHEN source IS NULL THEN 0 ELSE coalesce(l1.place, {2**h.BITS - 1}) END AS x1,
  len(list_filter({h.size_steps()}, lambda t: t <= size)) AS x2, (text_crc32 % {1 << h._HASH_BITS} * {h._CRC_FACTOR} + coalesce(doc_id, 0) % {1 << h._HASH_BITS} * {h._ID_FACTOR}) % {1 << h._HASH_BITS} AS u
  FROM sized LEFT JOIN l0 ON l0.v = lang LEFT JOIN l1 ON l1.v = source)"""
    # Axes to transposed curve index: from the top bit down, an axis whose bit is set reflects axis 0, another is exchanged with it.
    cells, last = ["c0 AS (SELECT DISTINCT x0, x1, x2, x0 AS a0, x1 AS a1, x2 AS a2 FROM rows_)"], "c0"
    for bit in range(top, 0, -1):
        q = 1 << bit
        for i in range(3):
            name = f"s{bit}_{i}"
            if i == 0:
                cells.append(f"{name} AS (SELECT x0, x1, x2, CASE WHEN a0 & {q} > 0 THEN xor(a0, {q - 1}) ELSE a0 END AS a0, a1, a2 FROM {last})")
            else:
                kept = ", ".join(f"CASE WHEN a{i} & {q} > 0 THEN a{i} ELSE xor(a{i}, xor(a0, a{i}) & {q - 1}) END AS a{i}" if j == i else f"a{j}" for j in (1, 2))
                cells.append(f"{name} AS (SELECT x0, x1, x2, CASE WHEN a{i} & {q} > 0 THEN xor(a0, {q - 1}) ELSE xor(a0, xor(a0, a{i}) & {q - 1}) END AS a0, {kept} FROM {last})")
            last = name
    cells.append(f"gray AS (SELECT x0, x1, x2, a0 AS g0, xor(a0, a1) AS g1, xor(xor(a0, a1), a2) AS g2 FROM {last})")
    flips = [f"CASE WHEN g2 & {1 << b} > 0 THEN {(1 << b) - 1} ELSE 0 END" for b in range(top, 0, -1)]
    flip = flips[0]
    for f in flips[1:]:
        flip = f"xor({flip}, {f})"
    cells.append(f"turned AS (SELECT *, {flip} AS f FROM gray)")
    digits = [(b, i) for b in range(top, -1, -1) for i in range(3)]
    curve = " + ".join(f"((xor(g{i}, f) >> {b}) & 1) * {1 << (len(digits) - 1 - n)}" for n, (b, i) in enumerate(digits))
    cells.append(f"curve AS (SELECT x0, x1, x2, CAST({curve} AS BIGINT) AS curve FROM turned)")
    placed = f"""counted AS (SELECT *, count(*) OVER (PARTITION BY curve) AS here, count(*) OVER () AS total FROM rows_ JOIN curve USING (x0, x1, x2)),
ranked AS (SELECT *, row_number() OVER (ORDER BY curve, u * CAST(ceil(here / {h.RUN_ROWS}) AS BIGINT) // {1 << h._HASH_BITS}, u, doc_id NULLS FIRST, text_crc32, size) - 1 AS place FROM counted)"""
    return f"""WITH {", ".join(levels)}, {measured}, {", ".join(cells)}, {placed}
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place * 16 // total AS INT) AS shard, CAST(place - (place * 16 // total * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, curve
FROM ranked"""


HILBERT_SHARDS = _hilbert()
SECRET_SCAN = _secret_spans()
