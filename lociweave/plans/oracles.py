"""The registered queries as statements for DuckDB."""

from __future__ import annotations

from lociweave.plans.derived import CALLSET, RAW, callset_sql

_SHARED = "greatest(0, least(a.end_pos, b.end_pos) - greatest(a.pos, b.pos))"
_JACCARD = f"CAST({_SHARED} AS DOUBLE) / CAST(greatest(a.end_pos, b.end_pos) - least(a.pos, b.pos) AS DOUBLE)"
_OVERLAP = f"CAST({_SHARED} AS DOUBLE) / CAST(greatest(a.end_pos - a.pos, b.end_pos - b.pos) AS DOUBLE)"
_PROXIMITY = "CAST(100 - abs(a.pos - b.pos) - abs(a.pos2 - b.pos2) AS DOUBLE) / 100.0E0"
_INSERTION = "sqrt((CAST(50 - abs(a.pos - b.pos) AS DOUBLE) / 50.0E0) * (CAST(least(a.svlen, b.svlen) AS DOUBLE) / CAST(greatest(a.svlen, b.svlen) AS DOUBLE)))"
_QUAL = "CAST(least(65535, greatest(0, floor(qual * 4))) AS INT)"
_CALLS = f"calls AS (SELECT *, {_QUAL} AS qual_q FROM ({callset_sql(CALLSET)}))"
_MICRO = "CAST(round(sim * 1000000) AS BIGINT) AS sim_micro"


def _lane(kind: str, left: str, right: str, unordered: bool, metric: str, t: str) -> str:
    cols = "a.src_index AS src_a, b.src_index AS src_b, a.chrom AS chrom, a.svtype AS svtype, a.pos AS pos_a, b.pos AS pos_b"
    order = " AND a.src_index < b.src_index" if unordered else ""
    on = {
        "interval": ("a.svtype IN ('DEL', 'DUP', 'INV') AND b.pos < a.end_pos AND b.end_pos > a.pos", metric, f"sim >= {t}"),
        "bnd": ("a.svtype = 'BND' AND a.chr2 = b.chr2 AND abs(a.pos - b.pos) < 50 AND abs(a.pos2 - b.pos2) < 50", _PROXIMITY, "sim > 0"),
        "ins": ("a.svtype = 'INS' AND abs(a.pos - b.pos) < 50", _INSERTION, "sim >= 0.75E0"),
    }[kind]
    return f"SELECT * FROM (SELECT {cols}, {on[1]} AS sim FROM {left} a JOIN {right} b ON a.chrom = b.chrom AND a.svtype = b.svtype AND {on[0]}{order}) WHERE {on[2]}"


def _pairs(kinds=("interval", "bnd", "ins"), left="side_a", right="side_b", unordered=False, metric=_JACCARD, t="0.75E0") -> str:
    return " UNION ALL ".join(_lane(k, left, right, unordered, metric, t) for k in kinds)


_SIDES = f"WITH {_CALLS}, side_a AS (SELECT * FROM calls WHERE src_index % 2 = 1), side_b AS (SELECT * FROM calls WHERE src_index % 2 = 0)"
_SHOW = f"SELECT src_a, src_b, chrom, svtype, pos_a, pos_b, {_MICRO} FROM pairs"


def _matched(**kinds) -> str:
    return f"{_SIDES}, pairs AS ({_pairs(**kinds)}) {_SHOW}"


_BOTH = f"{_SIDES}, pairs AS ({_pairs()})"
_SELF = f"{_CALLS}, edges AS ({_pairs(left='calls', right='calls', unordered=True)})"
_FIELDS = "src_index, chrom, svtype, pos, end_pos, svlen"


def _set(word: str) -> str:
    return f"{_BOTH} SELECT {_FIELDS} FROM side_a WHERE src_index {word} (SELECT src_a FROM pairs)"


def _annotation(value: str, out: str) -> str:
    joined = f"""{_BOTH}, m AS (SELECT p.src_a, p.pos_b, p.src_b, p.sim, b.ac, CAST(printf('%.3f', b.af) AS DOUBLE) AS af, b.ann FROM pairs p JOIN side_b b ON b.src_index = p.src_b),
    g AS (SELECT src_a, {value} AS v FROM m GROUP BY src_a)"""
    return f"{joined} SELECT side_a.src_index, g.v AS {out} FROM side_a LEFT JOIN g ON g.src_a = side_a.src_index"


_POOLED = "flatten(list(string_split(ann, ',') ORDER BY pos_b, src_b) FILTER (WHERE ann IS NOT NULL))"
_ANNOTATIONS = {
    "anno_max": ("CAST(round(max(af) * 1000000) AS BIGINT)", "max_af"),
    "anno_min": ("min(ac)", "min_ac"),
    "anno_mean": ("CAST(floor(round(CAST(sum(ac) AS DOUBLE) / count(ac), 6) * 1000) AS BIGINT)", "mean_ac"),
    "anno_first": ("first(ac ORDER BY pos_b, src_b)", "first_ac"),
    "anno_last": ("list_last(string_split(last(ann ORDER BY pos_b, src_b) FILTER (WHERE ann IS NOT NULL), ','))", "last_ann"),
    "anno_best": ("list(string_split(ann, ',')[1] ORDER BY sim DESC, pos_b, src_b)[1]", "best_ann"),
    "anno_all": (f"array_to_string({_POOLED}, ',')", "all_ann"),
    "anno_unique": (f"array_to_string(list_filter({_POOLED}, lambda x, i: list_position({_POOLED}, x) = i), ',')", "unique_ann"),
    "anno_count": ("CAST(count(*) AS INT)", "n_match"),
    "anno_similarity": ("CAST(round(max(CAST(printf('%.6f', sim) AS DOUBLE)) * 1000000) AS BIGINT)", "top_sim"),
    "anno_text_number": ("CAST(max(CASE WHEN ann IS NOT NULL THEN 0 END) AS BIGINT)", "max_ann"),
}

_INNER = r"coalesce(nullif(regexp_extract(alt, '^[^\[\]]*\[([^\[]*)\[', 1), ''), regexp_extract(alt, '^[^\[\]]*\]([^\]]*)\]', 1))"
_PLAIN = "CASE WHEN regexp_matches(alt, '^[ACGTNacgtn]+$') THEN length(alt) - length(ref) END"
_NORMAL = rf"""raw AS ({callset_sql(RAW)}), typed AS (SELECT *,
  coalesce(CASE WHEN length(alt) >= 3 AND alt LIKE '<%>' THEN CASE WHEN upper(alt[2:-2]) IN ('DEL', 'DUP', 'INV', 'BND', 'INS', 'TRA') THEN upper(alt[2:-2]) END
                WHEN length(alt) >= 4 AND alt NOT LIKE '<%' AND (contains(alt, '[') OR contains(alt, ']')) THEN 'BND' END,
           CASE WHEN upper(info_svtype) IN ('DEL', 'DUP', 'INV', 'BND', 'INS', 'TRA') THEN upper(info_svtype) END, 'UNKNOWN') AS kind,
  CAST(info_svlen AS BIGINT) AS len0, coalesce(CAST(info_end AS BIGINT), pos + abs(CAST(info_svlen AS BIGINT))) AS end0,
  nullif(regexp_extract({_INNER}, '^(.+):([0-9]+)$', 1), '') AS mate, TRY_CAST(regexp_extract({_INNER}, '^(.+):([0-9]+)$', 2) AS BIGINT) AS mate_pos,
  coalesce(nullif(abs(CAST(info_inslen AS BIGINT)), 0), nullif(abs(CAST(info_svlen AS BIGINT)), 0), CASE WHEN {_PLAIN} > 0 THEN {_PLAIN} END,
           nullif(length(coalesce(info_left, '')) + length(coalesce(info_right, '')), 0), 0) AS ins FROM raw),
judged AS (SELECT *, CASE WHEN kind = 'UNKNOWN' THEN 'unresolvable_svtype' WHEN kind = 'TRA' THEN 'unsupported_tra' WHEN kind = 'BND' AND (mate IS NULL OR coalesce(mate_pos, 0) <= 0) THEN 'malformed_bnd'
  WHEN kind = 'INS' AND ins <= 0 THEN 'unresolvable_ins_len' WHEN kind NOT IN ('BND', 'INS') AND end0 IS NULL THEN 'unresolvable_end'
  WHEN kind NOT IN ('BND', 'INS') AND end0 <= pos THEN 'end_le_pos' END AS why FROM typed),
n AS (SELECT src_index, caller_idx, chrom, pos, id, ref, alt, info_svtype, info_end, info_svlen, qual, filter, mate, why AS skip_reason, CASE WHEN why IS NULL THEN kind END AS svtype,
  CASE WHEN why IS NULL THEN CASE WHEN kind IN ('BND', 'INS') THEN pos + 1 ELSE end0 END END AS end_pos,
  CASE WHEN why IS NULL THEN CASE WHEN kind = 'INS' THEN CAST(ins AS BIGINT) WHEN kind <> 'BND' THEN coalesce(abs(len0), end0 - pos) END END AS svlen,
  CASE WHEN why IS NULL AND kind = 'BND' THEN mate END AS chr2, CASE WHEN why IS NULL AND kind = 'BND' THEN mate_pos END AS pos2 FROM judged)"""
_BIN = "CASE WHEN svtype IN ('BND', 'INS') OR end_pos - pos < 512 THEN 0 ELSE length(bin(end_pos - pos)) - 9 END"

_REACH = """reach AS (SELECT x AS src_index, y AS c FROM links UNION SELECT r.src_index, l.y FROM reach r JOIN links l ON r.c = l.x)"""
_CLUSTERED = f"""WITH RECURSIVE {_SELF}, links AS (SELECT src_a AS x, src_b AS y FROM edges WHERE sim >= 0.75E0 UNION SELECT src_b, src_a FROM edges WHERE sim >= 0.75E0), {_REACH},
low AS (SELECT src_index, min(c) AS c FROM reach GROUP BY src_index),
clusters AS (SELECT calls.src_index, coalesce(least(low.c, calls.src_index), calls.src_index) AS cluster_id FROM calls LEFT JOIN low USING (src_index))"""
_CENTRE = """inner_sums AS (SELECT s AS src_index, sum(sim) AS total FROM (SELECT a.src_index AS s, e.sim FROM edges e JOIN clusters a ON a.src_index = e.src_a JOIN clusters b ON b.src_index = e.src_b AND a.cluster_id = b.cluster_id
  UNION ALL SELECT b.src_index, e.sim FROM edges e JOIN clusters a ON a.src_index = e.src_a JOIN clusters b ON b.src_index = e.src_b AND a.cluster_id = b.cluster_id) GROUP BY s),
centres AS (SELECT c.src_index, coalesce(i.total / (count(*) OVER (PARTITION BY c.cluster_id) - 1), 0) AS centre FROM clusters c LEFT JOIN inner_sums i USING (src_index))"""


#: How the similarity of a merged group to a third one follows from those of its parts, p and q, which are 0 where absent.
_LINKS = {"average": "(CAST(nx AS DOUBLE) * p + CAST(ny AS DOUBLE) * q) / (nx + ny)", "complete": "least(p, q)"}


def _agglomerated(linkage: str) -> str:
    """Clusters as in ``_CLUSTERED`` under another linkage: each round every component merges its most similar pair of groups.

    ``rounds`` holds pairs of groups (merged false) with their similarity and sizes, and the merges done (merged true).
    """
    return f"""WITH RECURSIVE {_SELF}, links AS (SELECT src_a AS x, src_b AS y FROM edges WHERE sim >= 0.75E0 UNION SELECT src_b, src_a FROM edges WHERE sim >= 0.75E0), {_REACH},
low AS (SELECT src_index, min(c) AS c FROM reach GROUP BY src_index),
rounds AS (SELECT l.c AS comp, src_a AS a, src_b AS b, sim AS v, 1 AS na, 1 AS nb, false AS merged FROM edges JOIN low l ON l.src_index = src_a JOIN low m ON m.src_index = src_b AND m.c = l.c
  UNION ALL (
    WITH cur AS (SELECT * FROM rounds WHERE NOT merged),
    best AS (SELECT comp, a AS x, b AS y, na AS nx, nb AS ny FROM cur WHERE v >= 0.75E0 QUALIFY row_number() OVER (PARTITION BY comp ORDER BY v DESC, a, b) = 1),
    met AS (SELECT cur.*, x, y, nx, ny, CASE WHEN a IN (x, y) THEN b ELSE a END AS k, CASE WHEN a IN (x, y) THEN nb ELSE na END AS nk, a IN (x, y) OR b IN (x, y) AS touched FROM cur JOIN best USING (comp) WHERE NOT (a = x AND b = y)),
    joined AS (SELECT comp, x, nx, ny, k, nk, coalesce(max(v) FILTER (x IN (a, b)), 0.0E0) AS p, coalesce(max(v) FILTER (y IN (a, b)), 0.0E0) AS q FROM met WHERE touched GROUP BY ALL)
    SELECT comp, x AS a, y AS b, 0.0E0 AS v, nx AS na, ny AS nb, true AS merged FROM best
    UNION ALL SELECT comp, a, b, v, na, nb, false FROM met WHERE NOT touched
    UNION ALL SELECT comp, least(x, k), greatest(x, k), s, CASE WHEN x < k THEN nx + ny ELSE nk END, CASE WHEN x < k THEN nk ELSE nx + ny END, false FROM (SELECT *, {_LINKS[linkage]} AS s FROM joined) WHERE s > 0)),
merges AS (SELECT a, b FROM rounds WHERE merged),
climb AS (SELECT src_index, src_index AS c FROM calls UNION ALL SELECT climb.src_index, merges.a FROM climb JOIN merges ON merges.b = climb.c),
clusters AS (SELECT src_index, min(c) AS cluster_id FROM climb GROUP BY src_index)"""


def _reps(order: str, centre: bool = False, clustered: str = _CLUSTERED) -> str:
    more, join = (f", {_CENTRE}", "JOIN centres USING (src_index)") if centre else ("", "")
    return f"""{clustered}{more}, members AS (SELECT c.cluster_id, calls.*, first_value(calls.src_index) OVER (PARTITION BY c.cluster_id ORDER BY {order}) AS rep
  FROM clusters c JOIN calls USING (src_index) {join})"""


_PASS_QUAL = "is_pass DESC, qual_q DESC, caller_idx, src_index"
_SIGNED = "CASE svtype WHEN 'DEL' THEN -svlen WHEN 'BND' THEN 0 ELSE svlen END"
_PROVENANCE = """prov AS (SELECT cluster_id, rep AS src_index, max(caller_idx) FILTER (src_index = rep) AS lead, list_sort(list_distinct(list(caller_idx))) AS cs, count(*) AS n_merged FROM members GROUP BY cluster_id, rep),
named AS (SELECT *, array_to_string(list_transform(list_concat([lead], list_filter(cs, lambda x: x <> lead)), lambda x: 'c' || x), ',') AS callers, CAST(len(cs) AS INT) AS n_callers FROM prov)"""
_DEFAULT = "is_pass DESC, round(centre, 12) DESC, caller_idx, src_index"


def _picks(order: str) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, sample ORDER BY {order}, src_index <> rep, src_index) AS r, count(*) OVER (PARTITION BY cluster_id, sample) AS n FROM members),
picks AS (SELECT cluster_id, rep, sample, src_index, gt, n, len(list_filter(string_split_regex(gt, '[/|]'), lambda x: x <> '.')) AS c,
  len(list_filter(string_split_regex(gt, '[/|]'), lambda x: coalesce(TRY_CAST(x AS INT), 0) >= 1)) AS a FROM ranked WHERE r = 1)"""


_PICKS = _picks("is_pass DESC, qual_q DESC")


def _cohort(missing_to_ref: bool) -> str:
    blank, more = ("'0/0'", " + (3 - count(*)) * 2") if missing_to_ref else ("'./.'", "")
    gts = ", ".join(f"coalesce(max(gt) FILTER (sample = '{s}'), {blank}) AS gt_{s.lower()}" for s in ("S0", "S1", "S2"))
    return f"""{_reps(_PASS_QUAL)}, {_PICKS}, counted AS (SELECT cluster_id, rep, {gts}, CAST(sum(a) AS INT) AS ac, CAST(sum(c){more} AS INT) AS an FROM picks GROUP BY cluster_id, rep)
SELECT k.rep AS src_index, cluster_id, chrom, pos, gt_s0, gt_s1, gt_s2, k.ac AS ac, an, CAST(floor(CASE WHEN an > 0 THEN CAST(k.ac AS DOUBLE) / an END * 1000000) AS BIGINT) AS af_micro
FROM counted k JOIN calls ON calls.src_index = k.rep"""


_FLOAT_QUAL = "CAST(least(65535, greatest(0, floor(CAST(qual AS FLOAT) * 4))) AS INT)"
#: The callset as three files give it: numbered by contig, position and file; qualities as 32-bit numbers.
_FILE_CALLS = f"calls AS (SELECT * REPLACE (row_number() OVER (ORDER BY chrom, pos, caller_idx, src_index) - 1 AS src_index), src_index AS number, {_FLOAT_QUAL} AS qual_q FROM ({callset_sql(CALLSET)}))"


def _from_files(sql: str) -> str:
    return sql.replace(_CALLS, _FILE_CALLS)


def _scan() -> str:
    """Raw records as a file numbers and names them."""
    own = "CASE WHEN svtype IS NOT NULL AND id = '.' THEN chrom || '_' || pos || '_' || svtype || '_' || lineno ELSE id END AS id"
    shown = "coalesce(nullif(concat_ws(';', 'END=' || info_end, 'SVLEN=' || info_svlen, 'INSLEN=' || info_inslen), ''), '.') AS info"
    numbered = "numbered AS (SELECT n.*, raw.info_inslen, row_number() OVER (ORDER BY n.chrom, n.pos, src_index) AS lineno FROM n JOIN raw USING (src_index))"
    return f"WITH {_NORMAL}, {numbered} SELECT lineno, chrom, pos, {own}, svtype, end_pos, svlen, chr2, pos2, skip_reason, filter IN ('PASS', '.') AS is_pass, {_FLOAT_QUAL} AS qual_q, {shown} FROM numbered"


def _merged_files() -> str:
    cells = ", ".join(
        f"coalesce(max(CASE WHEN sample = 'S{i}' THEN gt || '{':.' * i}:' || (number % 50) || '{':.' * (2 - i)}' END), './.:.:.:.') AS cell_s{i}" for i in range(3)
    )
    return f"""{_from_files(_reps(_PASS_QUAL))}, {_PICKS}, counted AS (SELECT p.cluster_id, p.rep, {cells}, sum(a) AS ac, sum(c) AS an FROM (SELECT picks.*, calls.number FROM picks JOIN calls USING (src_index)) p GROUP BY p.cluster_id, p.rep)
SELECT 'r' || number AS id, chrom, svtype, pos, 'GT:DP_S0:DP_S1:DP_S2' AS format, cell_s0, cell_s1, cell_s2, CAST(k.ac AS VARCHAR) AS ac, CAST(k.an AS VARCHAR) AS an,
  CASE WHEN svtype <> 'BND' THEN CAST(end_pos AS VARCHAR) END AS info_end, CASE WHEN svtype <> 'BND' THEN CAST({_SIGNED} AS VARCHAR) END AS info_svlen
FROM counted k JOIN calls ON calls.src_index = k.rep"""


def _collapsed_files() -> str:
    cell = "gt || CASE caller_idx WHEN 0 THEN ':' || (number % 50) || ':.:.' WHEN 1 THEN ':.:' || (number % 50) || ':.' ELSE ':.:.:' || (number % 50) END AS cell"
    alt = "CASE svtype WHEN 'BND' THEN 'N[' || chr2 || ':' || pos2 || '[' WHEN 'INS' THEN '<INS>' ELSE '' END AS alt"
    return f"""{_from_files(_reps(_PASS_QUAL))}, {_PROVENANCE} SELECT 'r' || number AS id, chrom, pos, 'GT:DP_c0:DP_c1:DP_c2' AS format, {cell}, {alt}, callers, CAST(n_callers AS VARCHAR) AS n_callers, CAST(n_merged AS VARCHAR) AS n_merged
FROM named JOIN calls USING (src_index)"""


def _annotated_files() -> str:
    sides = f"WITH {_CALLS}, side_a AS (SELECT * FROM calls WHERE caller_idx = 0), side_b AS (SELECT * FROM calls WHERE caller_idx = 1)"
    joined = "m AS (SELECT src_a, b.svtype, CASE WHEN b.svtype <> 'BND' THEN b.svlen END AS len FROM pairs JOIN side_b b ON b.src_index = src_b), g AS (SELECT src_a, count(*) AS n, max(len) AS longest, min(svtype) AS kind FROM m GROUP BY src_a)"
    return f"{sides}, pairs AS ({_pairs()}), {joined} SELECT 'r' || src_index AS id, chrom, pos, CAST(coalesce(n, 0) AS VARCHAR) AS n, CAST(longest AS VARCHAR) AS longest, kind AS kinds FROM side_a LEFT JOIN g ON src_a = src_index"


_LISTED = "flatten(list(string_split(ann, ',') ORDER BY src_index <> rep, src_index) FILTER (WHERE ann IS NOT NULL))"


def core_oracle_sql() -> dict[str, str]:
    found = {
        "match_interval_jaccard": _matched(kinds=("interval",)),
        "match_interval_overlap": _matched(kinds=("interval",), metric=_OVERLAP, t="0.8E0"),
        "match_bnd": _matched(kinds=("bnd",)),
        "match_ins": _matched(kinds=("ins",)),
        "match_all": _matched(),
        "match_self": f"WITH {_SELF}, pairs AS (SELECT * FROM edges) {_SHOW}",
        "match_by_svtype": f"{_BOTH} SELECT svtype, count(*) AS n, CAST(sum(CAST(round(sim * 1000000) AS BIGINT)) AS BIGINT) AS sim_micro FROM pairs GROUP BY svtype",
        "match_contigs": f"{_BOTH} {_SHOW} WHERE chrom = 'chr2'",
        "match_resolved": f"{_BOTH} SELECT src_a, src_b, p.svtype, a.qual_q AS qual_q_a, b.qual_q AS qual_q_b, a.sample AS sample_a, b.sample AS sample_b, printf('%.6f', round(sim, 6))[1:5] AS sim_text"
        " FROM pairs p JOIN side_a a ON a.src_index = src_a JOIN side_b b ON b.src_index = src_b",
        "chr_set_filter": f"{_BOTH} SELECT src_a, src_b, p.chrom, p.svtype, pos_a, pos_b, {_MICRO} FROM pairs p JOIN side_a a ON a.src_index = src_a WHERE p.chrom IN ('chr1', 'chr2') AND (p.svtype <> 'BND' OR a.chr2 IN ('chr1', 'chr2'))",
        "set_intersect": _set("IN"),
        "set_difference": _set("NOT IN"),
        "setop_partition_check": f"{_BOTH} SELECT svtype, CAST(sum(i) AS BIGINT) AS n_intersect, CAST(sum(1 - i) AS BIGINT) AS n_setdiff, count(*) AS n_all FROM (SELECT svtype, CASE WHEN src_index IN (SELECT src_a FROM pairs) THEN 1 ELSE 0 END AS i FROM side_a) GROUP BY svtype",
        "resolve_svtype": f"WITH {_NORMAL} SELECT src_index, svtype, skip_reason FROM n",
        "resolve_end_svlen": f"WITH {_NORMAL} SELECT src_index, pos, end_pos, svlen FROM n WHERE svtype IN ('DEL', 'DUP', 'INV')",
        "parse_bnd_alt": f"WITH {_NORMAL} SELECT src_index, chr2, pos2, end_pos FROM n WHERE svtype = 'BND'",
        "ins_length": f"WITH {_NORMAL} SELECT src_index, svlen FROM n WHERE svtype = 'INS'",
        "synthesized_ids": f"WITH {_NORMAL} SELECT src_index, CASE WHEN svtype IS NOT NULL AND id = '.' THEN chrom || '_' || pos || '_' || svtype || '_' || src_index ELSE id END AS id FROM n",
        "skip_stats": f"WITH {_NORMAL} SELECT caller_idx, reason, count(*) AS n FROM (SELECT caller_idx, coalesce(skip_reason, CASE WHEN svtype = 'BND' AND chr2 NOT IN ('chr1', 'chr2') THEN 'chrom_filtered' END, 'kept') AS reason FROM n) GROUP BY caller_idx, reason",
        "size_bins": f"WITH {_NORMAL} SELECT svtype, CAST({_BIN} AS INT) AS size_bin, count(*) AS n FROM n WHERE svtype IS NOT NULL GROUP BY ALL",
        "signed_lengths": f"WITH {_NORMAL} SELECT src_index, CAST({_SIGNED} AS BIGINT) AS signed_svlen FROM n WHERE svtype IS NOT NULL",
        "qual_quantize": f"WITH {_NORMAL} SELECT src_index, CAST(least(65535, greatest(0, floor(qual * 20 * 4))) AS INT) AS qual_q, filter IN ('PASS', '.') AS is_pass FROM n",
        "info_filter": f"WITH raw AS ({callset_sql(RAW)}) SELECT src_index, coalesce(nullif(concat_ws(';', 'END=' || info_end, 'SVLEN=' || info_svlen), ''), '.') AS info FROM raw",
        "symbolic_alts": f"WITH {_NORMAL} SELECT src_index, CASE WHEN svtype IN ('DEL', 'DUP', 'INV', 'INS') THEN '<' || svtype || '>' ELSE '.' END AS alt FROM n",
        "edges_dedup": f"{_SIDES}, pairs AS ({_pairs()}) SELECT least(src_a, src_b) AS src_a, greatest(src_a, src_b) AS src_b, max(CAST(round(sim * 1000000) AS BIGINT)) AS sim_micro FROM pairs GROUP BY ALL",
        "components": f"WITH RECURSIVE {_SELF}, links AS (SELECT src_a AS x, src_b AS y FROM edges UNION SELECT src_b, src_a FROM edges), {_REACH} SELECT src_index, least(min(c), src_index) AS component FROM reach GROUP BY src_index",
        "large_components": f"WITH RECURSIVE {_SELF}, links AS (SELECT src_a AS x, src_b AS y FROM edges UNION SELECT src_b, src_a FROM edges), {_REACH}, low AS (SELECT src_index, least(min(c), src_index) AS component FROM reach GROUP BY src_index) SELECT component, count(*) AS n FROM low GROUP BY component HAVING count(*) >= 12",
        "cluster_average": f"{_agglomerated('average')} SELECT src_index, cluster_id FROM clusters",
        "cluster_complete": f"{_agglomerated('complete')} SELECT src_index, cluster_id FROM clusters",
        "collapse_average": f"{_reps(_DEFAULT, True, _agglomerated('average'))}, {_PROVENANCE} SELECT src_index, cluster_id, callers, n_callers, n_merged FROM named",
        "merge_average": f"{_reps(_DEFAULT, True, _agglomerated('average'))}, {_picks('is_pass DESC, caller_idx, caller_idx')} SELECT rep AS src_index, cluster_id, CAST(sum(a) AS INT) AS ac, CAST(sum(c) AS INT) AS an FROM picks GROUP BY cluster_id, rep",
        "cluster_single": f"{_CLUSTERED} SELECT src_index, cluster_id FROM clusters",
        "representative_pass_order": f"{_reps('is_pass DESC, caller_idx, src_index')} SELECT DISTINCT cluster_id, rep FROM members",
        "representative_qual": f"{_reps('qual_q DESC, caller_idx, src_index')} SELECT DISTINCT cluster_id, rep FROM members",
        "representative_pass_centre_order": f"{_reps('is_pass DESC, round(centre, 12) DESC, caller_idx, src_index', True)} SELECT DISTINCT cluster_id, rep FROM members",
        "collapse_callers": f"{_reps(_PASS_QUAL)}, {_PROVENANCE} SELECT named.src_index, cluster_id, chrom, svtype, pos, CAST({_SIGNED} AS BIGINT) AS svlen, callers, n_callers, n_merged FROM named JOIN calls USING (src_index)",
        "collapse_provenance": f"{_reps('qual_q DESC, caller_idx, src_index')}, {_PROVENANCE} SELECT callers, count(*) AS n, CAST(sum(n_merged) AS BIGINT) AS n_merged FROM named GROUP BY callers",
        "merge_cohort": _cohort(False),
        "merge_missing_to_ref": _cohort(True),
        "same_sample_pick": f"{_reps(_PASS_QUAL)}, {_PICKS} SELECT cluster_id, sample, src_index, gt, n FROM picks",
        "merge_allele_counts": f"{_reps(_PASS_QUAL)}, {_PICKS} SELECT ac, an, count(*) AS n FROM (SELECT CAST(sum(a) AS INT) AS ac, CAST(sum(c) AS INT) AS an FROM picks GROUP BY cluster_id) GROUP BY ac, an",
        "merge_callers_union": f"{_reps(_PASS_QUAL)}, lists AS (SELECT cluster_id, {_LISTED} AS l FROM members GROUP BY cluster_id), u AS (SELECT cluster_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM lists WHERE len(l) > 0) SELECT cluster_id, array_to_string(l, ',') AS callers, CAST(len(l) AS INT) AS n_callers FROM u",
    }
    found |= {k: _annotation(*v) for k, v in _ANNOTATIONS.items()}
    found |= {f"scan_{end}": _scan() for end in ("vcf", "vcf_gz", "bcf", "parquet")}
    found |= {"merge_files": _merged_files(), "collapse_files": _collapsed_files(), "annotate_files": _annotated_files()}
    found["unknown_contigs"] = (
        f"WITH {_NORMAL} SELECT chrom, CASE WHEN chrom = 'chr3' THEN 'unknown_contig' ELSE coalesce(skip_reason, CASE WHEN svtype = 'BND' AND chr2 <> 'chr1' THEN 'chrom_filtered' END, 'kept') END AS reason, count(*) AS n FROM n GROUP BY ALL"
    )
    found["anno_count"] = found["anno_count"].replace("g.v AS n_match", "coalesce(g.v, 0) AS n_match")
    return found
