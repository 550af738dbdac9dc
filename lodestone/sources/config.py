"""Configuration files: YAML (or JSON) of a folder, read by Spark and parsed on the driver, as patterns, normalisers and the
tables that the protocol operators take. A folder of configuration is a few small files; its text is collected."""

from __future__ import annotations

import fnmatch
import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

try:
    import yaml
except ImportError:  # JSON is read without it
    yaml = None

CHANNELS = "protocol string, channel string, signal string, required boolean"
ROLES = "protocol string, signal string, channel string, role string, width int"
VARIANTS = "protocol string, variant string, description string, needs array<string>, absent array<string>"
OVERRIDES = "protocol string, variant string, channel string, needs array<string>, score int, name_score int, pattern_score int"
RULES = "protocol string, id string, kind string, severity string, description string, channels array<string>, expression string"
STEPS = "protocol string, channel string, direction string, valid string, ready string, data string, depends_on array<string>"


def _parsed(text: str) -> dict:
    data = yaml.safe_load(text) if yaml else json.loads(text)
    if not isinstance(data or {}, dict):
        raise ValueError(f"a mapping was expected, not {type(data).__name__}")
    return data or {}


def files(spark: SparkSession, path: str, pattern: str = "*.yaml") -> list[tuple[str, str]]:
    """(path, text) of a file, or of a folder's files whose names match, in the order of their names."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").collect()
    one = len(rows) == 1 and rows[0]["path"].rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]
    return sorted((r["path"], r["value"]) for r in rows if one or fnmatch.fnmatchcase(r["path"].rsplit("/", 1)[-1], pattern))


def _only(spark: SparkSession, path: str) -> dict:
    return _parsed(files(spark, path)[0][1])


@dataclass(frozen=True)
class Patterns:
    """What the names of control and data signals contain."""

    control: tuple[str, ...] = S.CONTROL_NAMES
    data: tuple[str, ...] = S.DATA_NAMES
    source: str = "builtin"

    def overridden(self, control: list[str] | None = None, data: list[str] | None = None) -> Patterns:
        return Patterns(self.control if control is None else tuple(control), self.data if data is None else tuple(data), f"{self.source}+override")


def patterns(spark: SparkSession, path: str) -> Patterns:
    """The patterns of `rules`; a class for which there are none keeps the built-in ones."""
    rules = _only(spark, path).get("rules") or []
    of = lambda cls: tuple(p for r in rules if r.get("class") == cls for p in r.get("patterns") or [])
    return Patterns(of("control") or S.CONTROL_NAMES, of("data") or S.DATA_NAMES, f"yaml:{path}")


@dataclass(frozen=True)
class Normaliser:
    """What a name loses: see scalars.normalised()."""

    strip_prefix: tuple[str, ...] = ()
    strip_suffix: tuple[str, ...] = ()
    remove_infix: tuple[str, ...] = ()
    remove_underscore: bool = True
    take_last_dot: bool = True
    strip_array_index: bool = True

    def of(self, name: Column) -> Column:
        return S.normalised(name, self.strip_prefix, self.strip_suffix, self.remove_infix, self.take_last_dot, self.strip_array_index, self.remove_underscore)


def normaliser(spark: SparkSession, path: str, base: str | None = None) -> Normaliser:
    """The normaliser of a file. With a base, that one's with the file's changes: extra_… adds to a list, a list that isn't
    empty and a switch replace what is there; keys that a normaliser hasn't are passed over."""
    data, out = _only(spark, path), normaliser(spark, base) if base else Normaliser()
    for key in Normaliser.__dataclass_fields__:
        if data.get(f"extra_{key}"):
            out = replace(out, **{key: getattr(out, key) + tuple(data[f"extra_{key}"])})
        if isinstance(data.get(key), bool) or data.get(key):
            out = replace(out, **{key: data[key] if isinstance(data[key], bool) else tuple(data[key])})
    return out


@dataclass(frozen=True)
class Protocols:
    """Tables for protocol.score(): channels, roles, variants, overrides; errors (path, error) names files that were left out."""

    channels: DataFrame
    roles: DataFrame
    variants: DataFrame
    overrides: DataFrame
    errors: DataFrame


def _protocol(d: dict) -> tuple[list, list, list, list]:
    if "protocol" not in d:
        raise ValueError("no field 'protocol'")
    p = d["protocol"]
    name = lambda s: s["name"] if isinstance(s, dict) else s
    part = lambda x: round(100 * float(x))
    channels = []
    for c, spec in (d.get("channels") or {}).items():
        if "required" not in spec:
            raise ValueError(f"channel {c!r} has no field 'required'")
        channels += [(p, c, name(s), k == "required") for k in ("required", "optional") for s in spec.get(k) or []]
    roles = [(p, s, r.get("channel", ""), r.get("role", ""), r.get("width")) for s, r in (d.get("signal_roles") or {}).items() if isinstance(r, dict)]
    stated = d.get("variants") or []
    variants = [(p, v.get("name", ""), v.get("description", ""), v.get("needs_signals") or [], v.get("needs_absent_signals") or []) for v in stated]
    overrides = [(p, v.get("name", ""), o.get("channel", ""), o.get("required") or [], *[part(o.get(k, 0.5)) for k in ("score", "name_score", "pattern_score")]) for v in stated for o in v.get("channel_overrides") or []]
    return channels, roles, variants, overrides


def protocols(spark: SparkSession, path: str, pattern: str = "*.yaml") -> Protocols:
    """Every protocol of a folder, or that of a file. A file that can't be read is named in errors and harms no other; of two that
    name the same protocol the later one by path counts."""
    found, errors = {}, []
    for place, text in files(spark, path, pattern):
        try:
            data = _parsed(text)
            found[data.get("protocol")] = _protocol(data)
        except Exception as e:  # whatever a parser raises is that file's error
            errors.append((place, str(e)))
    tables = [[row for p in found.values() for row in p[i]] for i in range(4)]
    return Protocols(*[spark.createDataFrame(rows, ddl) for rows, ddl in zip(tables, (CHANNELS, ROLES, VARIANTS, OVERRIDES), strict=True)], spark.createDataFrame(errors, "path string, error string"))


@dataclass(frozen=True)
class Semantics:
    """channels (direction, valid, ready, data and what each depends on), rules for protocol.deadlocks(), forbidden (protocol,
    loop) and protocols (protocol, description, transfer, notes)."""

    channels: DataFrame
    rules: DataFrame
    forbidden: DataFrame
    protocols: DataFrame


def semantics(spark: SparkSession, path: str, name: str | None = None) -> Semantics:
    """The semantics of every protocol in a folder, or of one by name; a name that isn't there raises with those that are."""
    all_of = {d["protocol"]: d for _, text in files(spark, path) if "protocol" in (d := _parsed(text))}
    if name is not None and name not in all_of:
        raise FileNotFoundError(f"no semantics of {name!r}; there are {sorted(all_of)}")
    of = [(p, d) for p, d in sorted(all_of.items()) if name in (None, p)]
    text = lambda d, k, default="": (d.get(k) or default).strip()
    steps = [(p, c["name"], c.get("direction"), c.get("valid"), c.get("ready"), c.get("data"), c.get("depends_on") or []) for p, d in of for c in d.get("channels") or []]
    rules = [(p, r["id"], text(r, "kind"), text(r, "severity", "warning"), text(r, "description"), r.get("channels") or [], text(r, "expression")) for p, d in of for r in d.get("deadlock_rules") or []]
    loops = [(p, x) for p, d in of for x in d.get("forbidden_combinational_loops") or []]
    about = [(p, text(d, "description"), text(d, "transfer", "valid && ready"), text(d, "notes")) for p, d in of]
    make = spark.createDataFrame
    return Semantics(make(steps, STEPS), make(rules, RULES), make(loops, "protocol string, loop string"), make(about, "protocol string, description string, transfer string, notes string"))
