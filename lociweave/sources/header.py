"""Callset headers: reading, unifying several, and assembling the header of an output."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field

log = logging.getLogger("lociweave")

_ENTRY = re.compile(r'([A-Za-z0-9_]+)=("(?:[^"\\]|\\.)*"|[^,>]*)')


@dataclass(frozen=True)
class Field:
    id: str
    number: str
    type: str
    description: str = ""

    def line(self, kind: str) -> str:
        return f'##{kind}=<ID={self.id},Number={self.number},Type={self.type},Description="{self.description}">'


#: Definitions that every structural-variant output declares.
STANDARD_INFO = (
    Field("SVTYPE", "1", "String", "Type of structural variant"),
    Field("SVLEN", "1", "Integer", "Difference in length between REF and ALT alleles"),
    Field("END", "1", "Integer", "End position of the variant"),
    Field("CHR2", "1", "String", "Contig of the mate breakend"),
    Field("POS2", "1", "Integer", "Position of the mate breakend"),
)


@dataclass
class Header:
    info: dict[str, Field] = field(default_factory=dict)
    format: dict[str, Field] = field(default_factory=dict)
    filters: dict[str, str] = field(default_factory=dict)
    contigs: dict[str, int | None] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)
    other: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, lines: list[str]) -> Header:
        out = cls()
        for line in lines:
            if line.startswith("#CHROM"):
                out.samples = line.rstrip("\r\n").split("\t")[9:]
                continue
            kind, _, body = line[2:].partition("=")
            found = {k: v[1:-1] if v.startswith('"') else v for k, v in _ENTRY.findall(body)} if body.startswith("<") else {}
            name = found.get("ID")
            if kind in ("INFO", "FORMAT") and name:
                (out.info if kind == "INFO" else out.format).setdefault(name, Field(name, found.get("Number", "."), found.get("Type", "String"), found.get("Description", "")))
            elif kind == "FILTER" and name:
                out.filters.setdefault(name, found.get("Description", ""))
            elif kind == "contig" and name:
                length = found.get("length", "")
                out.contigs.setdefault(name, int(length) if length.isdigit() else None)
            elif kind != "fileformat" and line.strip():
                out.other.append(line.rstrip("\r\n"))
        out.filters.setdefault("PASS", "All filters passed")
        return out

    def copy(self) -> Header:
        return Header(dict(self.info), dict(self.format), dict(self.filters), dict(self.contigs), list(self.samples), list(self.other))

    def with_standard_info(self) -> Header:
        out = self.copy()
        for f in STANDARD_INFO:
            out.info.setdefault(f.id, f)
        return out

    def pruned(self, chr_set: tuple[str, ...] | None) -> Header:
        out = self.copy()
        if chr_set is not None:
            out.contigs = {k: v for k, v in out.contigs.items() if k in chr_set}
        return out

    def lines(self) -> list[str]:
        out = ["##fileformat=VCFv4.2"]
        out += [f'##FILTER=<ID={k},Description="{d}">' for k, d in sorted(self.filters.items(), key=lambda x: x[0] != "PASS")]
        out += [f"##contig=<ID={k}>" if n is None else f"##contig=<ID={k},length={n}>" for k, n in self.contigs.items()]
        out += [f.line("INFO") for f in self.info.values()] + [f.line("FORMAT") for f in self.format.values()] + self.other
        columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
        return [*out, "\t".join(columns + (["FORMAT", *self.samples] if self.samples else []))]


@dataclass
class Unified:
    """Fields of several headers under one set of definitions; ``renames[i]`` maps caller i's INFO or FORMAT names to new ones."""

    info: dict[str, Field]
    format: dict[str, Field]
    info_renames: list[dict[str, str]]
    format_renames: list[dict[str, str]]


def _unify(per_caller: list[dict[str, Field]], names: list[str], kind: str, wanted: set[str] | None) -> tuple[dict[str, Field], list[dict[str, str]]]:
    out: dict[str, Field] = {}
    renames: list[dict[str, str]] = [{} for _ in per_caller]
    for key in dict.fromkeys(k for fields in per_caller for k in fields):
        having = [(i, fields[key]) for i, fields in enumerate(per_caller) if key in fields]
        told = wanted is None or key in wanted
        if len({f.type for _, f in having}) > 1 and (kind, key) != ("FORMAT", "GT"):
            for i, f in having:
                fresh = f"{key}_{names[i]}"
                renames[i][key] = fresh
                out[fresh] = Field(fresh, f.number, f.type, f.description)
            if told:
                log.warning("%s field %s has different types; it is renamed by caller", kind, key)
            continue
        numbers = {f.number for _, f in having}
        if len(numbers) > 1 and kind == "FORMAT" and told:
            log.warning("FORMAT field %s has different numbers; Number becomes '.'", key)
        said = "; ".join(dict.fromkeys(f.description for _, f in having))
        out[key] = Field(key, numbers.pop() if len(numbers) == 1 else ".", having[0][1].type, said)
    return out, renames


def unify(headers: list[Header], names: list[str], info: list[str] | None = None, format: list[str] | None = None) -> Unified:
    """Same number and type: one definition with all descriptions. Same type only: Number '.'. Different types: one name per caller."""
    a, ra = _unify([h.info for h in headers], names, "INFO", set(info) if info else None)
    b, rb = _unify([h.format for h in headers], names, "FORMAT", set(format) if format else None)
    return Unified(a, b, ra, rb)


def keeps(name: str, wanted: list[str]) -> bool:
    """A wanted name keeps itself and what was renamed from it."""
    return any(name == w or name.startswith(f"{w}_") for w in wanted)


def contig_union(headers: list[Header], chr_set: tuple[str, ...] | None = None) -> dict[str, int | None]:
    """Contigs in the order of the first header, then those that later ones add."""
    out: dict[str, int | None] = {}
    for h in headers:
        for k, n in h.contigs.items():
            if chr_set is None or k in chr_set:
                out.setdefault(k, n)
    return out


def output_header(headers: list[Header], unified: Unified, keep_info: list[str], keep_format: list[str], samples: list[str], extra: tuple[Field, ...], command: str = "", chr_set: tuple[str, ...] | None = None) -> Header:
    out = Header(contigs=contig_union(headers, chr_set), samples=samples)
    for h in headers:
        for k, d in h.filters.items():
            out.filters.setdefault(k, d)
    standard = {f.id: f for f in STANDARD_INFO}
    out.info = {k: standard.get(k, f) for k, f in unified.info.items() if keeps(k, keep_info)}
    for f in (*STANDARD_INFO, *extra):
        if f.id in keep_info or f in extra:
            out.info[f.id] = f
    out.format = {k: f for k, f in unified.format.items() if keeps(k, keep_format)} if samples else {}
    out.other = ["##source=lociweave"] + ([f"##command={command}"] if command else [])
    return out


def single_samples(headers: list[Header]) -> list[str]:
    """Sample names for merging: exactly one per input, all distinct, two inputs at least."""
    if len(headers) < 2:
        raise ValueError("merge needs at least two inputs")
    if any(len(h.samples) != 1 for h in headers):
        raise ValueError("every input of merge must have exactly one sample")
    names = [h.samples[0] for h in headers]
    if len(set(names)) < len(names):
        raise ValueError(f"sample names repeat: {', '.join(names)}")
    return names


def collapse_sample(headers: list[Header]) -> list[str]:
    """The output's sample for collapsing: none, or the first input's; inputs have at most one and equally many."""
    if any(len(h.samples) > 1 for h in headers) or len({len(h.samples) for h in headers}) > 1:
        raise ValueError("inputs of collapse must all have one sample, or all have none")
    if not headers[0].samples:
        return []
    if len({h.samples[0] for h in headers}) > 1:
        log.warning("sample names differ; the first one is used")
    return [headers[0].samples[0]]
