"""The annotation language: OUTFIELD=FUNC(SRCFIELD)."""

from __future__ import annotations

import re
from dataclasses import dataclass

FUNCTIONS = ("max", "min", "mean", "first", "last", "best", "all", "unique")
COUNT, SIMILARITY = "MATCH_COUNT", "MATCH_SIMILARITY"
_SHAPE = re.compile(r"^([A-Za-z0-9_]+)=([A-Za-z]+)\(([A-Za-z0-9_]+)\)$")


@dataclass(frozen=True)
class Aggregate:
    out: str
    func: str
    source: str

    def number_and_type(self, source_type: str) -> tuple[str, str]:
        """Number and Type of the output's header definition."""
        if self.source == COUNT:
            return "1", "Integer"
        kind = "Float" if self.source == SIMILARITY or self.func == "mean" else source_type
        return ("." if self.func in ("all", "unique") else "1"), kind


def parse_aggregate(text: str) -> Aggregate:
    found = _SHAPE.match(text.strip())
    if not found:
        raise ValueError(f"expected OUTFIELD=FUNC(SRCFIELD), got {text!r}")
    out, func, source = found.groups()
    if func.lower() not in FUNCTIONS:
        raise ValueError(f"unknown function {func!r}; known: {', '.join(FUNCTIONS)}")
    return Aggregate(out, func.lower(), source)


def checked(specs: list[Aggregate], source_types: dict[str, str], existing: set[str] = frozenset(), overwrite: bool = False) -> list[Aggregate]:
    """Raises unless there is an expression, outputs are distinct and new (or ``overwrite``), and sources are known."""
    if not specs:
        raise ValueError("at least one expression is needed")
    for i, s in enumerate(specs):
        if s.out in {x.out for x in specs[:i]}:
            raise ValueError(f"output {s.out} is given twice")
        if s.source not in (COUNT, SIMILARITY) and s.source not in source_types:
            raise ValueError(f"{s.source} is not an INFO field of the database")
        if s.out in existing and not overwrite:
            raise ValueError(f"{s.out} exists in the input; overwrite is off")
    return specs
