"""An ontology from a YAML or JSON text: classes in a tree, relations with domains and ranges, other names for both."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class OntologyError(ValueError):
    """All faults that an ontology has, one a line."""


@dataclass(frozen=True)
class Relation:
    domain: tuple[str, ...]
    range: tuple[str, ...]
    symmetric: bool = False
    uri: str = ""
    description: str = ""


@dataclass(frozen=True)
class Ontology:
    """parents: each class's parent, None for a root; symmetric relations are marked, never mirrored."""

    parents: dict[str, str | None]
    relations: dict[str, Relation]
    version: str = "1"
    uris: dict[str, str] = field(default_factory=dict)
    descriptions: dict[str, str] = field(default_factory=dict)
    class_aliases: dict[str, str] = field(default_factory=dict)
    relation_aliases: dict[str, str] = field(default_factory=dict)

    def classes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.parents.items()), "class string, parent string")

    def signatures(self, spark: SparkSession) -> DataFrame:
        """(predicate, domain, range), a row for each pair that a relation allows."""
        rows = [(name, d, r) for name, relation in self.relations.items() for d in relation.domain for r in relation.range]
        return spark.createDataFrame(rows, "predicate string, domain string, range string")

    def canonical_class(self, name: Column) -> Column:
        return canonical(name, self.class_aliases)

    def canonical_relation(self, name: Column) -> Column:
        return canonical(name, self.relation_aliases)

    def prompt(self) -> str:
        """The vocabulary as instructions for an extractor."""
        known = [f"Entity classes: {', '.join(sorted(self.parents))}"]
        known += [f"  {name}: {self.descriptions.get(name, '')}" for name in self.parents]
        if old := sorted(self.class_aliases):
            known.append(f"Use the narrowest class that fits, and no other; {', '.join(old)} are former names, not to be used.")
        known.append("Relations (domain -> range):")
        for name, r in self.relations.items():
            known.append(f"  {name}: {' or '.join(r.domain)} -> {' or '.join(r.range)}{' (symmetric)' if r.symmetric else ''}. {r.description}")
        return "\n".join(known)


def canonical(name: Column, aliases: dict[str, str]) -> Column:
    """The name that an alias stands for; any other name as it is."""
    if not aliases:
        return name
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)), name), name)


def _parsed(text: str) -> dict:
    try:
        import yaml
    except ImportError:  # JSON needs no other library
        return json.loads(text)
    return yaml.safe_load(text)


def _listed(value: object) -> tuple[str, ...]:
    return tuple(value) if isinstance(value, list) else (value,) if value is not None else ()


def parse_ontology(text: str) -> Ontology:
    """The ontology of a text with classes, relations, class_aliases, relation_aliases and version.

    Faults, which are raised together: a parent that is no class; a cycle of parents; a relation without a
    domain or range, or with one that is no class; an alias that is a name itself or that stands for none.
    """
    data = _parsed(text) or {}
    specs = {name: spec or {} for name, spec in (data.get("classes") or {}).items()}
    parents = {name: spec.get("parent") for name, spec in specs.items()}
    faults = [f"class {name}: unknown parent {parent}" for name, parent in parents.items() if parent is not None and parent not in parents]
    settled = {name for name, parent in parents.items() if parent is None or parent not in parents}
    while more := {name for name, parent in parents.items() if name not in settled and parent in settled}:
        settled |= more
    faults += [f"class {name}: its parents form a cycle" for name in parents if name not in settled]
    relations = {}
    for name, spec in (data.get("relations") or {}).items():
        spec = spec or {}
        ends = {side: _listed(spec.get(side)) for side in ("domain", "range")}
        faults += [f"relation {name}: no {side}" for side, of in ends.items() if not of]
        faults += [f"relation {name}: unknown {side} {c}" for side, of in ends.items() for c in of if c not in parents]
        relations[name] = Relation(**ends, symmetric=bool(spec.get("symmetric")), uri=spec.get("uri") or "", description=spec.get("description") or "")
    aliases = {}
    for kind, names in (("class", parents), ("relation", relations)):
        aliases[kind] = data.get(f"{kind}_aliases") or {}
        faults += [f"{kind} alias {a}: it is a {kind}" for a in aliases[kind] if a in names]
        faults += [f"{kind} alias {a}: unknown {kind} {to}" for a, to in aliases[kind].items() if to not in names]
    if faults:
        raise OntologyError("\n".join(faults))
    of_each = lambda key: {name: spec[key] for name, spec in specs.items() if spec.get(key)}
    return Ontology(parents, relations, str(data.get("version", 1)), of_each("uri"), of_each("description"), aliases["class"], aliases["relation"])


def read_ontology(spark: SparkSession, path: str) -> Ontology:
    """The ontology of a file that Spark can read."""
    return parse_ontology(spark.read.text(path, wholetext=True).first()["value"])
