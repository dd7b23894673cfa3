"""Record literals of the test callsets, written out as VCF text."""

from __future__ import annotations

CONTIGS = {"chr1": 248956422, "chr2": 242193529, "chrX": 156040895}
_INFO = {
    "SVTYPE": ("1", "String"), "SVLEN": (".", "Integer"), "END": ("1", "Integer"), "INSLEN": ("1", "Integer"), "LEFT_SVINSSEQ": ("1", "String"), "RIGHT_SVINSSEQ": ("1", "String"),
    "AF": ("1", "Float"), "AC": ("1", "Integer"), "CALLER": ("1", "String"), "CALLERS": (".", "String"), "SCORE": ("1", "Integer"),
}


def header(info: list[str], samples: tuple[str, ...] = (), contigs=CONTIGS, types: dict | None = None) -> str:
    out = ["##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="All filters passed">', '##FILTER=<ID=LowQual,Description="Low quality">']
    out += [f"##contig=<ID={c},length={n}>" for c, n in contigs.items()]
    for k in info:
        number, kind = (types or {}).get(k, _INFO[k])
        out.append(f'##INFO=<ID={k},Number={number},Type={kind},Description="{k}">')
    if samples:
        out.append('##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">')
    return "\n".join([*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])])]) + "\n"


def interval(ident, chrom, pos, end, kind, more="", svlen=None, qual=".", filt="PASS", gt=None, info_type=None):
    length = svlen if svlen is not None else (pos - end if kind == "DEL" else end - pos)
    info = f"SVTYPE={info_type or kind};SVLEN={length};END={end}" + more
    return (chrom, pos, "\t".join([chrom, str(pos), ident, "N", f"<{kind}>", str(qual), filt, info, *(["GT", gt] if gt else [])]))


def raw(chrom, pos, ident, alt, info, ref="N", qual=".", filt="PASS", gt=None):
    return (chrom, pos, "\t".join([chrom, str(pos), ident, ref, alt, str(qual), filt, info, *(["GT", gt] if gt else [])]))


def bnd(ident, chrom, pos, mate, qual=".", gt=None, more=""):
    return raw(chrom, pos, ident, f"N[{mate}[", "SVTYPE=BND" + more, qual=qual, gt=gt)


def text(head: str, rows: list, contigs=CONTIGS) -> str:
    order = list(contigs)
    return head + "".join(line + "\n" for _, _, line in sorted(rows, key=lambda r: (order.index(r[0]), r[1])))


SV = ["SVTYPE", "SVLEN", "END", "INSLEN", "LEFT_SVINSSEQ", "RIGHT_SVINSSEQ"]

A = [
    interval("DEL_A_01", "chr1", 1000, 2000, "DEL"), interval("DEL_A_02", "chr1", 3000, 4000, "DEL"), interval("DEL_A_03", "chr1", 5000, 6000, "DEL"), interval("DEL_A_04", "chr1", 7000, 8000, "DEL"),
    interval("DEL_A_05", "chr1", 11000, 12000, "DEL"), interval("DEL_A_06", "chr1", 13000, 14000, "DEL"), interval("DEL_A_07", "chr1", 15000, 16000, "DEL"), interval("DEL_A_08", "chr1", 17000, 22000, "DEL"),
    interval("DUP_A_09", "chr2", 1000, 3000, "DUP"), interval("INV_A_09", "chrX", 5000, 7000, "INV"), interval("DUP_A_10", "chr1", 25000, 27000, "DUP"), interval("INV_A_10", "chr1", 28000, 30000, "INV"),
    raw("chr1", 33000, "DEL_A_12_alt_only", "<DEL>", "SVLEN=-1000;END=34000"), interval("DEL_A_13_conflict", "chr1", 35000, 36000, "DEL", info_type="DUP"), interval(".", "chr1", 37000, 38000, "DEL"),
    raw("chr1", 39000, "DEL_A_15_no_end_no_svlen", "<DEL>", "SVTYPE=DEL"), interval("DEL_A_16_bad_end", "chr1", 41000, 40500, "DEL", svlen=-500), interval("DEL_A_17_inconsistent", "chr1", 43000, 44000, "DEL", svlen=-1500),
    interval("DEL_A_18a", "chr1", 50000, 51000, "DEL"), interval("DEL_A_18b", "chr1", 50100, 51100, "DEL"), interval("DEL_A_18c", "chr1", 50050, 51050, "DEL"), interval("DUP_A_19a", "chr2", 5000, 7000, "DUP"), interval("DUP_A_19b", "chr2", 5500, 7500, "DUP"),
    bnd("BND_A_11", "chr1", 31000, "chr1:32000"), bnd("BND_A_20", "chr1", 60000, "chr2:70000"), bnd("BND_A_21", "chr1", 60500, "chr2:70000"), bnd("BND_A_22", "chr1", 80000, "chr2:90000"), bnd("BND_A_23", "chr1", 62000, "chrX:70000"),
    raw("chr1", 64000, "BND_A_24", "N[chr1:", "SVTYPE=BND"), bnd("BND_A_27a", "chr2", 60000, "chr2:80000"), bnd("BND_A_27b", "chr2", 60020, "chr2:80020"), raw("chr1", 70000, "TRA_A_25", "<TRA>", "SVTYPE=TRA"),
    raw("chr1", 32000, "INS_A_11", "<INS>", "SVTYPE=INS;SVLEN=100;END=32100"), raw("chr2", 100000, "INS_A_30_seq", "N" + "A" * 100, "SVTYPE=INS"), raw("chr2", 110000, "INS_A_31_inslen", "<INS>", "SVTYPE=INS;INSLEN=33"),
    raw("chr2", 120000, "INS_A_32_svinsseq", "<INS>", "SVTYPE=INS;LEFT_SVINSSEQ=" + "A" * 40 + ";RIGHT_SVINSSEQ=" + "C" * 50), raw("chr2", 130000, "INS_A_33_no_len", "<INS>", "SVTYPE=INS"), raw("chr2", 200000, "INS_A_34_alone", "<INS>", "SVTYPE=INS;SVLEN=200"),
]
B = [
    interval("DEL_B_01", "chr1", 1000, 2000, "DEL"), interval("DEL_B_02", "chr1", 3100, 4100, "DEL"), interval("DEL_B_03", "chr1", 5600, 6600, "DEL"), interval("DEL_B_04", "chr1", 9000, 10000, "DEL"), interval("DUP_B_05", "chr1", 11000, 12000, "DUP"),
    interval("DEL_B_06a", "chr1", 13050, 14050, "DEL"), interval("DEL_B_06b", "chr1", 12950, 13950, "DEL"), interval("DEL_B_08", "chr1", 17000, 18000, "DEL"), interval("DUP_B_09", "chr2", 1000, 3000, "DUP"), interval("INV_B_09", "chrX", 5000, 7000, "INV"),
    interval("DUP_B_10", "chr1", 25000, 27000, "DUP"), interval("INV_B_10", "chr1", 28000, 30000, "INV"), bnd("BND_B_11", "chr1", 31000, "chr1:32000"), bnd("BND_B_20", "chr1", 60000, "chr2:70000"), bnd("BND_B_21", "chr1", 60550, "chr2:70030"), bnd("BND_B_23", "chr1", 62000, "chr2:70000"),
    raw("chr2", 100000, "INS_B_30_seq", "N" + "A" * 100, "SVTYPE=INS"), raw("chr2", 110010, "INS_B_31_close", "<INS>", "SVTYPE=INS;SVLEN=33"), raw("chr2", 120005, "INS_B_32_close", "<INS>", "SVTYPE=INS;SVLEN=85"), raw("chr2", 100060, "INS_B_35_outside", "<INS>", "SVTYPE=INS;SVLEN=100"),
]
_DB = ["SVTYPE", "SVLEN", "END", "AF", "AC", "CALLER", "CALLERS"]
DB = [
    interval("DEL_DB_01", "chr1", 1000, 2000, "DEL", ";AF=0.10;AC=5;CALLER=manta;CALLERS=manta,delly"), interval("DEL_DB_02", "chr1", 3000, 4000, "DEL", ";AF=0.50;AC=25;CALLER=delly;CALLERS=delly"),
    interval("DEL_DB_06b", "chr1", 12950, 13950, "DEL", ";AF=0.30;AC=15;CALLER=delly;CALLERS=delly,gatk"), interval("DEL_DB_06a", "chr1", 13050, 14050, "DEL", ";AF=0.20;AC=10;CALLER=manta;CALLERS=manta"),
    bnd("BND_DB_11", "chr1", 31000, "chr1:32000", more=";AF=0.40;AC=20;CALLER=manta;CALLERS=manta,gridss"),
]
_INS50 = "N" + "A" * 50
CALLER1 = [
    interval("DEL_D_01", "chr1", 1000, 2000, "DEL", qual=50, gt="0/1"), interval("DEL_D_02", "chr1", 3000, 4000, "DEL", qual=30, filt="LowQual", gt="0/0"), interval("DEL_D_03", "chr1", 5000, 6000, "DEL", qual=40, gt="1/1"),
    interval("DUP_D_01", "chr1", 9000, 10000, "DUP", qual=50, gt="0/1"), bnd("BND_D_01", "chr1", 31000, "chr1:32000", qual=50, gt="0/1"), raw("chr1", 40000, "INS_D_01", _INS50, "SVTYPE=INS", qual=50, gt="0/1"),
]
CALLER2 = [
    interval("DEL_M_01", "chr1", 1000, 2000, "DEL", qual=80, gt="1/1"), interval("DEL_M_02", "chr1", 3100, 4100, "DEL", qual=80, gt="0/1"), interval("DEL_M_03", "chr1", 7000, 8000, "DEL", qual=80, gt="0/0"),
    interval("DUP_M_01", "chr1", 9000, 10000, "DUP", qual=80, gt="1/1"), bnd("BND_M_01", "chr1", 31000, "chr1:32000", qual=80, gt="0/1"), raw("chr1", 40000, "INS_M_01", _INS50, "SVTYPE=INS", qual=80, gt="1/1"),
]
COHORT = {
    "S1": [interval("a", "chr1", 1000, 2000, "DEL", gt="0/1"), interval("b", "chr1", 3000, 4000, "DEL", gt="1/1"), interval("c", "chr1", 9000, 10000, "DUP", gt="0/1"), bnd("d", "chr1", 31000, "chr1:32000", gt="0/1"), raw("chr1", 40000, "e", _INS50, "SVTYPE=INS", gt="0/1")],
    "S2": [interval("a", "chr1", 1000, 2000, "DEL", gt="1/1"), interval("c", "chr1", 9000, 10000, "DUP", gt="0/0"), bnd("d", "chr1", 31000, "chr1:32000", gt="0/1"), raw("chr1", 40000, "e", _INS50, "SVTYPE=INS", gt="1/1")],
    "S3": [interval("a", "chr1", 1100, 2100, "DEL", gt="0/0"), interval("f", "chr1", 28000, 30000, "INV", gt="0/1"), bnd("d", "chr1", 31000, "chr1:32000", gt="1/1")],
}


def write_all(folder) -> dict[str, str]:
    """Writes every fixture as text and returns the paths by name."""
    files = {"A": text(header(SV), A), "B": text(header(SV), B), "DB": text(header(_DB), DB), "Caller1": text(header(SV, ("SAMPLE1",)), CALLER1), "Caller2": text(header(SV, ("SAMPLE1",)), CALLER2)}
    files |= {s: text(header(SV, (s,)), rows) for s, rows in COHORT.items()}
    out = {}
    for name, body in files.items():
        path = folder / f"{name}.vcf"
        path.write_text(body)
        out[name] = str(path)
    return out
