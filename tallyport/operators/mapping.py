"""Table mappings: which source column goes to which target column, and the checks before a run."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what a table or column may be called.
IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_$]*$")


def checked(name: str) -> str:
    name = name.strip()
    if not IDENTIFIER.match(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def normalized_fields(mapping: dict[str, str]) -> dict[str, str]:
    """Trimmed renames; empty pairs and identities are dropped, halves and two sources for one target refused. Swaps are fine."""
    out: dict[str, str] = {}
    targets: set[str] = set()
    for source, target in mapping.items():
        source, target = source.strip(), target.strip()
        if not source and not target:
            continue
        if not source or not target:
            raise ValueError(f"half of a field pair is missing: {source!r} -> {target!r}")
        source, target = checked(source), checked(target)
        if target in targets:
            raise ValueError(f"two source fields go to {target}")
        targets.add(target)
        if source != target:
            out[source] = target
    return out


def normalized_names(names: list[str]) -> list[str]:
    """Trimmed, valid, each once, in order."""
    return list(dict.fromkeys(checked(n) for n in names if n.strip()))


def normalized_pairs(pairs: list[str]) -> list[str]:
    """`source->target` texts, trimmed, each once, in order."""
    out = []
    for text in pairs:
        if text.strip():
            source, arrow, target = text.partition("->")
            if not arrow:
                raise ValueError(f"not a pair: {text!r}")
            out.append(f"{checked(source)}->{checked(target)}")
    return list(dict.fromkeys(out))


@dataclass
class TableMapping:
    source_table: str
    target_table: str
    key: str
    fields: dict[str, str] = field(default_factory=dict)
    ignored: list[str] = field(default_factory=list)
    confirmed_types: list[str] = field(default_factory=list)
    custom_where: str = ""

    def __post_init__(self):
        self.source_table, self.target_table, self.key = map(checked, (self.source_table, self.target_table, self.key))
        self.fields, self.ignored, self.confirmed_types = normalized_fields(self.fields), normalized_names(self.ignored), normalized_pairs(self.confirmed_types)

    @property
    def target_key(self) -> str:
        return self.target_of(self.key)

    def target_of(self, source: str) -> str:
        return self.fields.get(source) or source

    def pairs(self, source_columns: list[str], target_columns: list[str] | None = None) -> list[tuple[str, str]]:
        """(source, target) of the columns that are copied, in source order."""
        if self.key in self.ignored or self.key not in source_columns:
            raise ValueError(f"the key {self.key} is missing or ignored")
        out = [(c, self.target_of(c)) for c in source_columns if c not in self.ignored]
        names = [t for _, t in out]
        if twice := {t for t in names if names.count(t) > 1}:
            raise ValueError(f"two source columns go to {sorted(twice)}")
        if target_columns is not None and (lost := [t for t in names if t not in target_columns]):
            raise ValueError(f"the target has no column {lost}")
        return out

    def select(self, source: DataFrame, filtered: bool = True) -> DataFrame:
        """The mapped projection of a source; custom_where (Spark SQL) applies to snapshots."""
        rows = source.where(self.custom_where) if filtered and self.custom_where else source
        return rows.select(*[F.col(s).alias(t) for s, t in self.pairs(source.columns)])


def validated(mappings: list[TableMapping]) -> list[TableMapping]:
    """At least one table; no source or target table twice."""
    if not mappings:
        raise ValueError("no table is mapped")
    for what in ("source_table", "target_table"):
        names = [getattr(m, what) for m in mappings]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"{what} {twice} is mapped twice")
    return mappings


def after_image(change: Column, columns: list[str]) -> list[Column]:
    """Columns of the row after an update; the row before is not applied."""
    return [change["after"][c].alias(c) for c in columns]
