"""A folder of rules: one file per head, `<predicate>_<arity>.dl`, statements in order."""

from __future__ import annotations

import re
from pathlib import Path

from .language import ProgramError, Rule, parse


def split(text: str) -> dict[str, str]:
    """File name and text of each group of rules; queries are refused."""
    found: dict[str, list[str]] = {}
    for r in parse(text):
        if not isinstance(r, Rule):
            raise ProgramError(f"a rule store holds no queries: {r}")
        doc = "".join(f"%% {line}\n" for line in r.doc.splitlines())
        found.setdefault(f"{r.head.name}_{len(r.head.terms)}.dl", []).append(f"{doc}{r}\n")
    return {k: "\n".join(v) for k, v in found.items()}


def export(text: str, folder: str) -> list[str]:
    """Write a program's groups, replacing those that are there; the names written."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    groups = split(text)
    for name, body in groups.items():
        (Path(folder) / name).write_text(body)
    return sorted(groups)


def read(folder: str) -> str:
    """The program of a folder; a file that holds another head than its name says is refused."""
    parts = []
    for path in sorted(Path(folder).glob("*.dl")):
        if not re.fullmatch(r"\w+_\d+\.dl", path.name):
            raise ProgramError(f"{path.name} is not named <predicate>_<arity>.dl")
        body = path.read_text()
        if other := set(split(body)) - {path.name}:
            raise ProgramError(f"{path.name} holds rules of {sorted(other)}")
        parts.append(body)
    return "\n".join(parts)
