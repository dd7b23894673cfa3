"""Canonical callset columns."""

#: As a source reads them; ``raw`` is the record verbatim.
RECORD_COLUMNS = (
    "caller_idx int, lineno long, chrom string, chrom_idx int, pos long, id string, ref string, alt array<string>, qual float, "
    "filters array<string>, info map<string,string>, format array<string>, samples array<string>, raw string"
)
#: Added by ``normalize``; null in skipped records but for ``skip_reason``.
NORMAL_COLUMNS = "svtype string, end_pos long, svlen long, chr2 string, pos2 long, size_bin int, is_pass boolean, qual_q int, skip_reason string"

#: What the joins need of a record.
LOCUS = ("src_index", "chrom", "svtype", "pos", "end_pos", "svlen", "chr2", "pos2")
