"""Configurations: JSON or YAML files, folders of schemas, archives; pattern files; declarations."""

from __future__ import annotations

import io
import ipaddress
import json
import re
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.builtins import java_pattern, json_type
from ..plans.language import Atom, Const, ProgramError, Rule
from .database import Relation

KINDS = ("contains", "starts_with", "ends_with", "regex_match", "base64", "base64_utf16le", "cidr")
PARTS = ("sources", "matchers", "declarations")


class ConfigError(ValueError):
    """A configuration that is not valid."""


class _Folder:
    """Names and bytes of the files in a folder or an archive."""

    def __init__(self, path: str):
        self.archive = zipfile.ZipFile(io.BytesIO(Path(path).read_bytes())) if path.endswith(".zip") else None
        self.path = Path(path)

    def names(self) -> list[str]:
        return sorted(self.archive.namelist() if self.archive else (f.name for f in self.path.iterdir() if f.is_file()))

    def read(self, name: str) -> str:
        return (self.archive.read(name) if self.archive else (self.path / name).read_bytes()).decode("utf-8-sig")


def read_patterns(text: str) -> list[str]:
    """Patterns of a pattern file: one a line, trimmed, # begins a comment line."""
    return [p for line in text.splitlines() if (p := line.strip()) and p[0] != "#"]


def _parsed(name: str, text: str) -> dict:
    if not name.endswith((".yaml", ".yml")):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ConfigError(f"{name} needs PyYAML") from e
    return yaml.safe_load(text) or {}


def read_config(path: str) -> dict:
    """The configuration in a JSON or YAML file, or merged from a folder's or archive's *.json files.

    Pattern files (`contains_from` and its like) are read from beside it, so the result stands alone.
    """
    if path.endswith(".zip") or Path(path).is_dir():
        folder = _Folder(path)
        names = [n for n in folder.names() if n.endswith(".json") and "/" not in n]
    else:
        folder, names = _Folder(str(Path(path).parent)), [Path(path).name]
    whole: dict = {p: [] for p in PARTS}
    for name in names:
        part = _parsed(name, folder.read(name))
        for m in part.get("matchers") or ():
            for kind in KINDS:
                if f"{kind}_from" in m:
                    m[kind] = [*m.get(kind, ()), *read_patterns(folder.read(m.pop(f"{kind}_from")))]
        for p in PARTS:
            whole[p] += part.get(p) or []
    check(whole)
    return whole


def check(config: dict) -> None:
    """Raise ConfigError unless mappings, matchers and declarations are well formed."""
    for s in config.get("sources", ()):
        for m in s["mappings"]:
            if m.get("expr") and any(m.get(k) for k in ("predicate", "args", "filter")):
                raise ConfigError("a mapping has either expr or predicate, args and filter")
            if not m.get("expr") and not m.get("predicate"):
                raise ConfigError("a mapping needs expr or predicate")
    for m in config.get("matchers", ()):
        if any(f"{k}_from" in m for k in KINDS):
            raise ConfigError("a matcher's pattern file was not read; use read_config")
        if not m.get("predicate") or m.get("term", -1) < 0 or not any(k in m for k in KINDS):
            raise ConfigError("a matcher needs a predicate, a term of 0 or more and patterns")
        try:
            for p in m.get("regex_match", ()):
                re.compile(java_pattern(p))
            for p in m.get("cidr", ()):
                ipaddress.ip_network(p, strict=False)
        except ValueError as e:
            raise ConfigError(str(e)) from e
        except re.error as e:
            raise ConfigError(f"invalid pattern: {e}") from e
    for d in config.get("declarations", ()):
        names = [t.get("name") or str(i) for i, t in enumerate(d.get("terms", ()))]
        if len(set(names)) != len(names):
            raise ConfigError(f"{d['name']} has a term name twice")


def term_names(declarations: list[dict]) -> dict[tuple[str, int], list[str]]:
    """Names of the terms of each declared (predicate, arity), for the encoder."""
    return {(d["name"], len(d.get("terms", ()))): [t.get("name") or str(i) for i, t in enumerate(d.get("terms", ()))] for d in declarations}


def _type_of(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int) or isinstance(value, float) and value.is_integer():
        return "integer"
    return "float" if isinstance(value, float) else "string" if isinstance(value, str) else "json"


def check_types(rules: list[Rule], declarations: list[dict]) -> None:
    """Raise ProgramError where an atom's arity or a constant's type is not as declared.

    A predicate is free unless it is declared; the first declaration of a (predicate, arity) counts,
    one without terms is documentation only.
    """
    known: dict[tuple[str, int], dict] = {}
    for d in declarations:
        if d.get("terms") and not d.get("docOnly"):
            known.setdefault((d["name"], len(d["terms"])), d)
    names = {n for n, _ in known}
    for r in rules:
        for a in (r.head, *r.body):
            if not isinstance(a, Atom) or a.name not in names:
                continue
            if (a.name, len(a.terms)) not in known:
                raise ProgramError(f"{a.name} is declared, but not with {len(a.terms)} terms: {r}")
            for t, d in zip(a.terms, known[a.name, len(a.terms)]["terms"], strict=True):
                if isinstance(t, Const) and d.get("type") and _type_of(t.value) != d["type"]:
                    raise ProgramError(f"{t} is not of the declared type {d['type']}: {r}")


def mistyped(rel: Relation, declaration: dict) -> DataFrame:
    """The facts with a value that is not of its declared type; loading keeps them, this reports them."""
    bad = F.lit(False)
    for i, t in enumerate(declaration["terms"]):
        if want := t.get("type"):
            have = json_type((F.col(f"c{i}"), rel.kinds[i]))[0]
            bad = bad | ~(have.isin("object", "array") if want == "json" else have == want)
    return rel.df.where(bad)
