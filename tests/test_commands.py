"""End-to-end runs over the fixture callsets, with the expected values worked out by hand or by independent formulas."""

from __future__ import annotations

import gzip
from pathlib import Path

import fixtures as fx
import pytest

from lociweave import commands
from lociweave.cli import main
from lociweave.operators.annotate import annotate
from lociweave.options import ClusterOptions, MatchOptions
from lociweave.plans.runtime import drop_all_staged
from lociweave.sources import bcf
from lociweave.sources.bgzf import decompress
from lociweave.sources.csi import bin_of, read_bins
from lociweave.sources.vcf import read_callset, read_header, write_lines


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    return fx.write_all(tmp_path_factory.mktemp("vcf"))


def body(path) -> list[list[str]]:
    data = Path(path).read_bytes()
    if path.endswith(".bcf"):
        raw = decompress(data)
        _, names, contigs, at = bcf.read_header(raw)
        lines = list(bcf.decode(raw, at, names, contigs))
    else:
        lines = [x for x in (gzip.decompress(data) if path.endswith(".gz") else data).decode().splitlines() if not x.startswith("#")]
    return [x.split("\t") for x in lines]


def info(row) -> dict[str, str]:
    return {k: v for k, _, v in (x.partition("=") for x in row[7].split(";"))}


def ids(path):
    return [r[2] for r in body(path)]


MATCHES = {
    ("DEL_A_01", "DEL_B_01"): ("1.000000", "1.000000"), ("DEL_A_02", "DEL_B_02"): ("0.900000", "0.818182"), ("DEL_A_06", "DEL_B_06a"): ("0.950000", "0.904762"), ("DEL_A_06", "DEL_B_06b"): ("0.950000", "0.904762"),
    ("DUP_A_09", "DUP_B_09"): ("1.000000",) * 2, ("INV_A_09", "INV_B_09"): ("1.000000",) * 2, ("DUP_A_10", "DUP_B_10"): ("1.000000",) * 2, ("INV_A_10", "INV_B_10"): ("1.000000",) * 2,
    ("BND_A_11", "BND_B_11"): ("1.000000",) * 2, ("BND_A_20", "BND_B_20"): ("1.000000",) * 2, ("INS_A_30_seq", "INS_B_30_seq"): ("1.000000",) * 2,
    ("INS_A_31_inslen", "INS_B_31_close"): ("0.894427",) * 2, ("INS_A_32_svinsseq", "INS_B_32_close"): ("0.921954",) * 2,
}


def pairs(path):
    return {(r[2], r[5]): r[7] for r in body(path) if r[0] != "CHROM_A"}


@pytest.mark.parametrize("flag, column", [({"min_overlap": 0.5}, 0), ({"min_overlap": 0.8}, 0), ({"min_jaccard": 0.5}, 1), ({}, 1)])
def test_match(spark, files, tmp_path, flag, column):
    out = str(tmp_path / "m.tsv")
    commands.run_match(spark, files["A"], files["B"], out, MatchOptions(**flag))
    assert pairs(out) == {k: v[column] for k, v in MATCHES.items()}
    first = Path(out).read_text().splitlines()
    assert first[0].startswith("##match_metric=") and first[1].split("\t") == ["CHROM_A", "POS_A", "ID_A", "CHROM_B", "POS_B", "ID_B", "SVTYPE", "SIMILARITY"]


def test_match_slops_and_contigs(spark, files, tmp_path):
    out = str(tmp_path / "m.tsv")
    commands.run_match(spark, files["A"], files["B"], out, MatchOptions(bnd_slop=100))
    assert pairs(out)[("BND_A_21", "BND_B_21")] == "0.600000" and len(pairs(out)) == 14
    commands.run_match(spark, files["A"], files["B"], out, MatchOptions(ins_slop=20))
    assert ("INS_A_31_inslen", "INS_B_31_close") not in pairs(out)
    commands.run_match(spark, files["A"], files["B"], out, MatchOptions(chrs=("chr2",)))
    assert {r[0] for r in body(out)[1:]} == {"chr2"}
    commands.run_match(spark, files["A"], files["B"], out, MatchOptions(chrs=("chrY",)))
    assert pairs(out) == {}


def test_match_self_and_info(spark, files, tmp_path):
    out = str(tmp_path / "m.tsv")
    commands.run_match(spark, files["A"], None, out, MatchOptions(min_overlap=0.5))
    assert pairs(out) == {
        ("DEL_A_18a", "DEL_A_18c"): "0.950000", ("DEL_A_18a", "DEL_A_18b"): "0.900000", ("DEL_A_18c", "DEL_A_18b"): "0.950000", ("DUP_A_19a", "DUP_A_19b"): "0.750000", ("BND_A_27a", "BND_A_27b"): "0.600000",
    }
    commands.run_match(spark, files["A"], files["DB"], out, MatchOptions(min_overlap=0.5), ["AF", "SVTYPE"])
    rows = {(r[2], r[5]): r[8:] for r in body(out)[1:]}
    assert rows[("DEL_A_01", "DEL_DB_01")] == ["SVTYPE=DEL", "AF=0.100000;SVTYPE=DEL"]


def test_annotate(spark, files, tmp_path):
    out = str(tmp_path / "a.vcf")
    specs = ["MX=max(AF)", "MN=min(AF)", "AV=mean(AF)", "WHO=unique(CALLER)", "LISTS=unique(CALLERS)", "N=first(MATCH_COUNT)", "B=best(CALLER)", "S=max(MATCH_SIMILARITY)", "EACH=all(AC)"]
    commands.run_annotate(spark, files["A"], files["DB"], specs, out, MatchOptions(min_overlap=0.5))
    rows = {r[2]: info(r) for r in body(out)}
    assert len(rows) == len(fx.A)
    six = rows["DEL_A_06"]
    assert [six[k] for k in ("MX", "MN", "AV", "WHO", "LISTS", "N", "B", "EACH")] == ["0.300000", "0.200000", "0.250000", "delly,manta", "delly,gatk,manta", "2", "delly", "15,10"]
    assert rows["DEL_A_07"]["N"] == "0" and "MX" not in rows["DEL_A_07"]
    assert rows["BND_A_11"]["MX"] == "0.400000" and rows["BND_A_11"]["S"] == "1.000000"
    assert rows["TRA_A_25"]["N"] == "0" and "MX" not in rows["INS_A_11"]
    head = read_header(spark, out)
    assert (head.info["MX"].number, head.info["MX"].type, head.info["EACH"].number, head.info["N"].type) == ("1", "Float", ".", "Integer")
    with pytest.raises(ValueError):
        commands.run_annotate(spark, out, files["DB"], ["MX=max(AF)"], str(tmp_path / "b.vcf"))
    commands.run_annotate(spark, out, files["DB"], ["MX=min(AF)"], str(tmp_path / "b.vcf"), MatchOptions(min_overlap=0.5), overwrite=True)
    assert {r[2]: info(r) for r in body(str(tmp_path / "b.vcf"))}["DEL_A_06"]["MX"] == "0.200000"


def test_set_operations(spark, files, tmp_path):
    a, b = str(tmp_path / "i.vcf"), str(tmp_path / "d.vcf")
    commands.run_setop(spark, "intersect", files["A"], files["B"], a)
    commands.run_setop(spark, "setdiff", files["A"], files["B"], b)
    source = [x.split("\t") for x in Path(files["A"]).read_text().splitlines() if not x.startswith("#")]
    assert sorted(body(a) + body(b)) == sorted(source)
    assert set(ids(a)) == {k[0] for k in MATCHES}
    commands.run_setop(spark, "setdiff", files["B"], files["B"], b)
    assert ids(b) == []
    commands.run_setop(spark, "intersect", files["B"], files["B"], a)
    assert len(ids(a)) == len(fx.B)
    with pytest.raises(ValueError):
        commands.run_setop(spark, "intersect", files["A"], files["B"], str(tmp_path / "x.txt"))


def test_skips_and_ids(spark, files):
    rows = {r["id"]: r for r in read_callset(spark, files["A"])[0].collect()}
    why = {k: r["skip_reason"] for k, r in rows.items() if r["skip_reason"]}
    assert why == {
        "DEL_A_15_no_end_no_svlen": "unresolvable_end", "DEL_A_16_bad_end": "end_le_pos", "BND_A_24": "malformed_bnd", "TRA_A_25": "unsupported_tra", "INS_A_33_no_len": "unresolvable_ins_len",
    }
    named = [k for k in rows if k.startswith("chr1_37000_DEL_")]
    assert named == [f"chr1_37000_DEL_{rows[named[0]]['lineno']}"]
    assert rows["DEL_A_13_conflict"]["svtype"] == "DEL" and rows["DEL_A_12_alt_only"]["svtype"] == "DEL" and rows["DEL_A_08"]["size_bin"] == 4
    assert [rows[k]["svlen"] for k in ("INS_A_30_seq", "INS_A_31_inslen", "INS_A_32_svinsseq", "INS_A_11", "DEL_A_17_inconsistent")] == [100, 33, 90, 100, 1500]


def test_collapse(spark, files, tmp_path):
    out = str(tmp_path / "c.vcf")
    commands.run_collapse(spark, [("Caller1", files["Caller1"]), ("Caller2", files["Caller2"])], out, ClusterOptions(match=MatchOptions(min_jaccard=0.5)))
    rows = {r[2]: r for r in body(out)}
    assert list(rows) == ["DEL_D_01", "DEL_M_02", "DEL_D_03", "DEL_M_03", "DUP_D_01", "BND_D_01", "INS_D_01"]
    got = {k: tuple(info(r)[x] for x in ("CALLERS", "N_CALLERS", "N_MERGED")) for k, r in rows.items()}
    assert got["DEL_D_01"] == ("Caller1,Caller2", "2", "2") and got["DEL_M_02"] == ("Caller2,Caller1", "2", "2") and got["DEL_D_03"] == ("Caller1", "1", "1") and got["DEL_M_03"] == ("Caller2", "1", "1")
    assert rows["BND_D_01"][4] == "N[chr1:32000[" and rows["INS_D_01"][4] == "N" + "A" * 50 and rows["DEL_D_01"][4] == "."
    assert rows["DEL_D_01"][9] == "0/1" and info(rows["DEL_D_01"])["SVLEN"] == "-1000" and info(rows["DUP_D_01"])["SVLEN"] == "1000"
    commands.run_collapse(spark, [("x", files["Caller1"]), ("y", files["Caller2"])], out, ClusterOptions(priority=("QUAL",), match=MatchOptions(min_jaccard=0.5)), info=["END"], formats=[])
    rows = body(out)
    assert [r[2] for r in rows] == ["DEL_M_01", "DEL_M_02", "DEL_D_03", "DEL_M_03", "DUP_M_01", "BND_M_01", "INS_M_01"] and len(rows[0]) == 8
    assert set(info(rows[0])) == {"END", "CALLERS", "N_CALLERS", "N_MERGED"}


COHORT = {
    "1000": ("DEL", ["0/1", "1/1", "0/0"], 3, 6, 0.5, 6), "3000": ("DEL", ["1/1", "./.", "./."], 2, 2, 1.0, 6), "9000": ("DUP", ["0/1", "0/0", "./."], 1, 4, 0.25, 6),
    "28000": ("INV", ["./.", "./.", "0/1"], 1, 2, 0.5, 6), "31000": ("BND", ["0/1", "0/1", "1/1"], 4, 6, 4 / 6, 6), "40000": ("INS", ["0/1", "1/1", "./."], 3, 4, 0.75, 6),
}


@pytest.mark.parametrize("to_ref, end", [(False, ".vcf"), (True, ".vcf.gz"), (False, ".bcf")])
def test_merge(spark, files, tmp_path, to_ref, end):
    out = str(tmp_path / f"m{end}")
    commands.run_merge(spark, [files[s] for s in ("S1", "S2", "S3")], out, missing_to_ref=to_ref, write_index=True)
    rows = body(out)
    assert [r[1] for r in rows] == list(COHORT)
    for r in rows:
        kind, gts, ac, an, af, an_ref = COHORT[r[1]]
        i = info(r)
        assert i["SVTYPE"] == kind and int(i["AC"]) == ac and int(i["AN"]) == (an_ref if to_ref else an)
        assert float(i["AF"]) == pytest.approx(ac / an_ref if to_ref else af, abs=1e-6)
        assert r[9:12] == [g.replace(".", "0") if to_ref else g for g in gts]
        assert r[4] == {"BND": "N[chr1:32000[", "INS": "N" + "A" * 50}.get(kind, f"<{kind}>")
        assert not {"SRC_INDEX", "CALLER_IDX", "SID", "N_MERGED"} & set(i)
    if end != ".vcf":
        bins = read_bins(gzip.decompress(Path(out + ".csi").read_bytes()))
        assert bin_of(999, 2000) in bins[0] and bins[1] == {}


def test_same_sample_collisions_are_told(spark, tmp_path, caplog):
    rows = [fx.interval("a", "chr1", 1000, 2000, "DEL", gt="0/0", filt="LowQual"), fx.interval("b", "chr1", 1000, 2000, "DEL", gt="0/1")]
    for s, r in (("S1", rows), ("S2", fx.COHORT["S2"])):
        (tmp_path / f"{s}.vcf").write_text(fx.text(fx.header(fx.SV, (s,)), r))
    out = str(tmp_path / "m.vcf")
    with caplog.at_level("WARNING", logger="lociweave"):
        commands.run_merge(spark, [str(tmp_path / "S1.vcf"), str(tmp_path / "S2.vcf")], out, verbose=True)
    assert "1 records were passed over" in caplog.text
    assert body(out)[0][9:11] == ["0/1", "1/1"]


def test_callers_are_united(spark, tmp_path):
    for s, names in (("S1", "delly,manta"), ("S2", "gatk, delly")):
        (tmp_path / f"{s}.vcf").write_text(fx.text(fx.header([*fx.SV, "CALLERS"], (s,)), [fx.interval("a", "chr1", 1000, 2000, "DEL", f";CALLERS={names}", gt="0/1")]))
    out = str(tmp_path / "m.vcf")
    commands.run_merge(spark, [str(tmp_path / "S1.vcf"), str(tmp_path / "S2.vcf")], out)
    assert (info(body(out)[0])["CALLERS"], info(body(out)[0])["N_CALLERS"]) == ("delly,manta,gatk", "3")


def test_merge_rejects(spark, files):
    for paths in (["S1"], ["S1", "S1"], ["S1", "A"]):
        with pytest.raises(ValueError):
            commands.run_merge(spark, [files[p] for p in paths], "-")


def test_missing_alleles_do_not_count(spark, tmp_path):
    from lociweave.operators.merge import alternate, called

    rows = spark.createDataFrame([(".|.",), ("./1",), ("0|2",), (".",)], "gt string")
    got = rows.select(called(rows.gt), alternate(rows.gt)).collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 1), (2, 1), (0, 0)]


def test_type_conflicts_and_new_contigs(spark, tmp_path):
    one = fx.text(fx.header([*fx.SV, "SCORE"], ("S1",)), [fx.interval("a", "chr1", 1000, 2000, "DEL", ";SCORE=5", gt="0/1")])
    contigs = {"chr1": 1, "chrM": 16569}
    two = fx.text(fx.header([*fx.SV, "SCORE"], ("S2",), contigs, {"SCORE": ("1", "String")}), [fx.interval("b", "chrM", 10, 900, "DEL", ";SCORE=x", gt="0/1")], contigs)
    for n, t in (("p", one), ("q", two)):
        (tmp_path / f"{n}.vcf").write_text(t)
    out = str(tmp_path / "o.vcf")
    commands.run_collapse(spark, [("p", str(tmp_path / "p.vcf")), ("q", str(tmp_path / "q.vcf"))], out, info=["SCORE"])
    rows = {r[2]: info(r) for r in body(out)}
    assert rows["a"]["SCORE_p"] == "5" and rows["b"]["SCORE_q"] == "x"
    assert list(read_header(spark, out).contigs) == ["chr1", "chr2", "chrX", "chrM"]


def test_multiallelic_is_an_error(spark, tmp_path):
    path = tmp_path / "x.vcf"
    path.write_text(fx.text(fx.header(fx.SV), [fx.raw("chr1", 5, "x", "<DEL>,<DUP>", "END=900")]))
    with pytest.raises(Exception, match="more than one ALT"):
        read_callset(spark, str(path))[0].collect()


def test_bcf_round_trip(spark, files, tmp_path):
    for name in ("A", "DB", "S1"):
        lines = [x for x in Path(files[name]).read_text().splitlines() if not x.startswith("#")]
        out = str(tmp_path / f"{name}.bcf")
        write_lines(iter(lines), read_header(spark, files[name]), out, write_index=True)
        again = [r["raw"] for r in read_callset(spark, out)[0].orderBy("lineno").collect()]
        strip = lambda x: x.replace("0.10;", "0.1;").replace("0.50;", "0.5;").replace("0.30;", "0.3;").replace("0.20;", "0.2;").replace("0.40;", "0.4;")
        assert again == [strip(x) for x in lines]
    a, b = str(tmp_path / "1.tsv"), str(tmp_path / "2.tsv")
    commands.run_match(spark, files["A"], files["B"], a)
    commands.run_match(spark, str(tmp_path / "A.bcf"), files["B"], b)
    assert Path(a).read_text() == Path(b).read_text()


def test_bcf_beyond_32_bits(spark, tmp_path):
    from lociweave.sources import vcf

    header = vcf.Header.parse(fx.header(fx.SV).splitlines())
    starts = [1, 2**31 - 1, 2**31, 2**31 + 1, 9_000_000_000]
    lines = [f"chr1\t{p}\tr{p}\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END={p + 500};SVLEN={-n}" for n, p in enumerate(starts + [2**40])]
    lines.append(f"chr1\t{2**40}\tw\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END={2**40 + 2**33};SVLEN={-(2**33)}")
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string").orderBy("i")
    vcf.write_callset(df, header, out := str(tmp_path / "wide.bcf"))
    again = read_callset(spark, out)[0].orderBy("lineno").collect()
    assert [r["raw"] for r in again] == lines and [r["lineno"] for r in again] == list(range(1, 8)) and again[4]["pos"] == 9_000_000_000
    raw = Path(out).read_bytes()
    (tmp_path / "cut.bcf").write_bytes(raw[: len(raw) - 40])
    with pytest.raises(Exception, match="ends within a compressed block"):
        read_callset(spark, str(tmp_path / "cut.bcf"))[0].collect()


def test_index_needed(spark, files, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_callset(spark, files["A"], index_needed=True)
    out = str(tmp_path / "m.tsv")
    assert main(["match", files["A"], files["B"], "-o", out, "--require-index"]) == 1
    for f in ("A", "B"):
        lines = [x for x in Path(files[f]).read_text().splitlines() if not x.startswith("#")]
        write_lines(iter(lines), read_header(spark, files[f]), str(tmp_path / f"{f}.vcf.gz"), write_index=True)
    assert main(["match", str(tmp_path / "A.vcf.gz"), str(tmp_path / "B.vcf.gz"), "-o", out, "--require-index"]) == 0 and len(pairs(out)) == 13


def depths(tmp_path, name, kind, sample, rows):
    head = fx.header(fx.SV, (sample,)).replace("##FORMAT=<ID=GT", f'##FORMAT=<ID=DP,Number=1,Type={kind},Description="Depth">\n##FORMAT=<ID=GT', 1)
    text = fx.text(head, [fx.interval(i, "chr1", 1000 + 5000 * n, 2000 + 5000 * n, "DEL", gt=gt) for n, (i, gt, _) in enumerate(rows)])
    cells = {i: dp for i, _, dp in rows}
    lines = [x if x.startswith("#") else "\t".join([*x.split("\t")[:8], "GT:DP", f"{x.split(chr(9))[9]}:{cells[x.split(chr(9))[2]]}"]) for x in text.splitlines()]
    (tmp_path / f"{name}.vcf").write_text("\n".join(lines) + "\n")
    return str(tmp_path / f"{name}.vcf")


@pytest.mark.parametrize("end", [".bcf", ".parquet"])
def test_format_conflicts_are_renamed(spark, tmp_path, end):
    one = depths(tmp_path, "p", "Integer", "S1", [("a", "0/1", 7), ("b", "1/1", 8)])
    two = depths(tmp_path, "q", "String", "S2", [("c", "0/0", "many")])
    out = str(tmp_path / f"m{end}")
    commands.run_merge(spark, [one, two], out, formats=["DP"])
    rows = {r["id"]: r for r in read_callset(spark, out)[0].collect()}
    assert rows["a"]["format"] == ["GT", "DP_S1", "DP_S2"] and rows["a"]["samples"] == ["0/1:7:.", "0/0:.:many"] and rows["b"]["samples"] == ["1/1:8:.", "./.:.:."]
    kinds = {k: f.type for k, f in read_header(spark, out).format.items()}
    assert kinds == {"GT": "String", "DP_S1": "Integer", "DP_S2": "String"}
    commands.run_merge(spark, [one, two], out)  # a conflict in a field that is not asked for changes nothing
    assert {tuple(r["format"]) for r in read_callset(spark, out)[0].collect()} == {("GT",)}
    commands.run_collapse(spark, [("p", one), ("q", two)], out, formats=["GT", "DP"])
    assert [r["samples"] for r in read_callset(spark, out)[0].orderBy("lineno").collect()] == [["0/1:7:."], ["1/1:8:."]]
    assert {"DP_p", "DP_q"} < set(read_header(spark, out).format)


@pytest.mark.parametrize("end", [".vcf.gz", ".bcf"])
def test_blocks_of_many_tasks_make_one_file(spark, tmp_path, monkeypatch, end):
    from lociweave.sources import vcf

    monkeypatch.setattr(vcf, "_PIECE", 10)  # a piece for every full block
    header = vcf.Header.parse(fx.header(fx.SV).splitlines())
    lines = [f"chr1\t{i + 1}\tr{i}\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END={i + 500}" for i in range(9000)]
    out = str(tmp_path / f"x{end}")
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string").repartition(7).orderBy("i")
    assert vcf.write_callset(df, header, out) == 9000
    assert ["\t".join(r) for r in body(out)] == lines
    assert [r["raw"] for r in read_callset(spark, out)[0].orderBy("lineno").collect()] == lines


def test_large_components_are_told_without_being_asked(spark, tmp_path, caplog):
    rows = [fx.interval(f"r{i}", "chr1", 1000 + i // 20, 9000 + i // 20, "DEL", gt="0/1") for i in range(520)]
    for s, r in (("S1", rows), ("S2", rows[:10])):
        (tmp_path / f"{s}.vcf").write_text(fx.text(fx.header(fx.SV, (s,)), r))
    with caplog.at_level("WARNING", logger="lociweave"):
        commands.run_collapse(spark, [(s, str(tmp_path / f"{s}.vcf")) for s in ("S1", "S2")], str(tmp_path / "c.vcf"), ClusterOptions(linkage="single"), formats=[])
    assert "chr1, DEL: 530 records" in caplog.text and "caller 0 has 98.1 %" in caplog.text


def test_several_files_under_one_path_keep_their_numbers(spark, files, tmp_path):
    """Numbers go on from file to file in the order of names, split or not."""
    lines = [x for x in Path(files["A"]).read_text().splitlines() if not x.startswith("#")]
    head = [x for x in Path(files["A"]).read_text().splitlines() if x.startswith("#")]
    (tmp_path / "parts").mkdir()
    for i in range(3):
        (tmp_path / "parts" / f"{i}.vcf").write_text("\n".join([*head, *lines[i * 9 : (i + 1) * 9 if i < 2 else None]]) + "\n")
    got = read_callset(spark, str(tmp_path / "parts"))[0].orderBy("lineno").collect()
    assert [r["lineno"] for r in got] == list(range(1, len(lines) + 1)) and [r["raw"] for r in got] == lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = read_callset(spark, files["A"])[0].orderBy("lineno").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["lineno"] for r in got] == list(range(1, len(lines) + 1)) and [r["raw"] for r in got] == lines


def test_command_line(spark, files, tmp_path):
    out = str(tmp_path / "m.tsv")
    assert main(["match", files["A"], files["B"], "--output", out]) == 0 and len(pairs(out)) == 13
    assert drop_all_staged(spark) == 0  # a command leaves no staged table behind
    assert main(["match", files["A"]]) == 1
    assert main(["collapse", f"p:{files['Caller1']}", files["Caller2"], "-o", str(tmp_path / "c.vcf.gz"), "--min-jaccard", "0.5"]) == 0
    assert info(body(str(tmp_path / "c.vcf.gz"))[0])["CALLERS"] == "p,Caller2"
    assert main(["merge", f"n:{files['S1']}", files["S2"], "-o", str(tmp_path / "z.vcf")]) == 1
    assert main(["anno", files["A"], files["DB"], "-a", "X=nope(AF)", "-o", str(tmp_path / "z.vcf")]) == 1


def test_stream(spark, files, tmp_path):
    from lociweave.functions.aggspec import parse_aggregate
    from lociweave.streaming.live import annotate_stream, match_stream

    a, db = read_callset(spark, files["A"])[0], read_callset(spark, files["DB"])[0]
    a.write.parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema(a.schema).parquet(str(tmp_path / "a"))
    q = match_stream(stream, db).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("live").count() == 5
    seen = []
    specs = [parse_aggregate("N=max(MATCH_COUNT)")]
    q = annotate_stream(stream, db, specs, lambda df, n: seen.extend(df.select("id", "N").collect())).option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["id"]: r["N"] for r in seen} == {r["id"]: r["N"] for r in annotate(a, db, specs).select("id", "N").collect()}
