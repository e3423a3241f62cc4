"""Declarative output: fields by path, renaming, and what to do about missing values."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.paths import compile_path
from kinfold.sources.readers import ConfigError

ON_MISSING = ("null", "omit", "error")


@dataclass(frozen=True)
class Field:
    """An output field. type and normalize are accepted and have no effect."""

    path: str
    source: str | None = None
    type: str | None = None
    required: bool = False
    normalize: str | None = None
    on_missing: str | None = None


@dataclass(frozen=True)
class OutputConfig:
    fields: tuple[Field, ...]
    include_confidence: bool = True
    include_provenance: bool = True
    on_missing: str = "null"
    extra: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, spec: dict) -> OutputConfig:
        """Checked configuration; paths aren't checked, an unknown one is missing in every record."""
        try:
            fields = tuple(Field(f["path"], f.get("from", f.get("from_path")), f.get("type"), bool(f.get("required", False)), f.get("normalize"), f.get("on_missing")) for f in spec["fields"])
        except (KeyError, TypeError, AttributeError) as error:
            raise ConfigError(f"fields need a path: {error}") from error
        config = cls(fields, bool(spec.get("include_confidence", True)), bool(spec.get("include_provenance", True)), spec.get("on_missing", "null"))
        if not fields:
            raise ConfigError("at least one field is needed")
        for choice in (config.on_missing, *(f.on_missing for f in fields)):
            if choice is not None and choice not in ON_MISSING:
                raise ConfigError(f"on_missing is one of {ON_MISSING}, not {choice!r}")
        return config

    @classmethod
    def load(cls, path: str) -> OutputConfig:
        try:
            with open(path, encoding="utf-8") as file:
                return cls.parse(json.load(file))
        except (OSError, ValueError, TypeError) as error:
            raise ConfigError(f"can't load {path}: {error}") from error


# The first of the configurations that come with the engine.
PRESETS = {
    "default": {"fields": [
        {"path": "full_name", "required": True}, {"path": "primary_email", "from": "emails[0]", "required": True}, {"path": "phone", "from": "phones[0]"},
        {"path": "current_company"}, {"path": "title"}, {"path": "skills", "from": "skills[].name"}, {"path": "city", "from": "location.city"},
        {"path": "country", "from": "location.country"}, {"path": "years_experience"}, {"path": "linkedin", "from": "links.linkedin"}, {"path": "github", "from": "links.github"},
    ]},
    "contacts": {"fields": [{"path": "who", "from": "full_name"}, {"path": "emails"}, {"path": "phones"}], "include_confidence": False, "include_provenance": False, "on_missing": "omit"},
    "audit": {"fields": [{"path": "candidate_id"}, {"path": "full_name"}]},
}


def _json(c: Column) -> Column:
    """Any value as JSON text; null is null."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)


def project(records: DataFrame, config: OutputConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed output columns and ``json``, the object with only the fields that are to be there.

    A missing field is null, or under ``omit`` absent from json (null in its column). ``error`` on a required
    field drops the record; on others it acts as null. Of equal output names the last counts.
    """
    out: dict[str, tuple[Column, Column | None]] = {}
    alive = F.lit(True)
    for f in config.fields:
        choice = f.on_missing or config.on_missing
        found = compile_path(f.source or f.path, records.schema)
        value, present = (found[0], found[1]) if found else (F.lit(None).cast("string"), F.lit(False))
        if choice == "error" and f.required:
            alive = alive & present
        out[f.path] = (F.when(present, value), present if choice == "omit" else None)
    if config.include_confidence and "overall_confidence" in records.columns:
        out["overall_confidence"] = (F.col("overall_confidence"), None)
    if config.include_provenance and "provenance" in records.columns:
        out["provenance"] = (F.col("provenance"), None)
    entry = lambda name, value: F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), _json(value))
    texts = [F.when(shown, entry(n, v)) if shown is not None else entry(n, v) for n, (v, shown) in out.items()]
    whole = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*texts)), ","), F.lit("}"))
    kept = [F.col(k) for k in keep if k not in out]
    return records.filter(alive).select(*kept, *[v.alias(n) for n, (v, _) in out.items()], whole.alias("json"))
