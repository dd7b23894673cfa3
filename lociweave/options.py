"""Options of the six commands and their checks."""

from __future__ import annotations

from dataclasses import dataclass, field

SVTYPES = ("DEL", "DUP", "INV", "BND", "INS")
INTERVAL_TYPES = ("DEL", "DUP", "INV")
LINKAGES = ("average", "single", "complete")
CRITERIA = ("PASS", "QUAL", "CENTRE", "ORDER")


def name_list(text: str | None, what: str) -> list[str] | None:
    """A comma-separated list, trimmed; empty lists, empty tokens and repeats are errors."""
    if text is None:
        return None
    names = [x.strip() for x in text.split(",")]
    if any(not x for x in names):
        raise ValueError(f"{what}: empty name in {text!r}")
    if len(set(names)) < len(names):
        raise ValueError(f"{what}: repeated name in {text!r}")
    return names


def parse_priority(text: str) -> tuple[str, ...]:
    """Criteria in the order given; ORDER is appended where it is not last."""
    found = tuple("CENTRE" if x.strip().upper() == "CENTER" else x.strip().upper() for x in text.split(","))
    for x in found:
        if x not in CRITERIA:
            raise ValueError(f"priority: unknown criterion {x!r}")
    return found if found[-1] == "ORDER" else (*found, "ORDER")


@dataclass(frozen=True)
class MatchOptions:
    """Thresholds of the fuzzy joins. Exactly one interval metric holds: Jaccard unless ``min_overlap`` is given."""

    min_jaccard: float | None = None
    min_overlap: float | None = None
    bnd_slop: int = 50
    ins_slop: int = 50
    min_ins_sim: float = 0.75
    chrs: tuple[str, ...] | None = None
    chr_set: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.min_jaccard is not None and self.min_overlap is not None:
            raise ValueError("min_overlap and min_jaccard exclude each other")
        if self.min_jaccard is None and self.min_overlap is None:
            object.__setattr__(self, "min_jaccard", 0.75)
        for name in ("min_jaccard", "min_overlap", "min_ins_sim"):
            x = getattr(self, name)
            if x is not None and not 0 < x <= 1:
                raise ValueError(f"{name} must be above 0 and at most 1")
        for name in ("bnd_slop", "ins_slop"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.chr_set is not None:
            if self.chrs is None:
                object.__setattr__(self, "chrs", self.chr_set)
            elif not set(self.chrs) <= set(self.chr_set):
                raise ValueError("chrs must lie within chr_set")

    @property
    def metric(self) -> str:
        return "jaccard" if self.min_overlap is None else "overlap"

    @property
    def threshold(self) -> float:
        return self.min_jaccard if self.min_overlap is None else self.min_overlap


@dataclass(frozen=True)
class ClusterOptions:
    linkage: str = "average"
    priority: tuple[str, ...] = ("PASS", "CENTRE", "ORDER")
    match: MatchOptions = field(default_factory=MatchOptions)

    def __post_init__(self) -> None:
        if self.linkage not in LINKAGES:
            raise ValueError(f"linkage must be one of {', '.join(LINKAGES)}")
        object.__setattr__(self, "priority", parse_priority(",".join(self.priority)))
