"""Layered settings: base file, environment file, environment variables, arguments.

A layer is a set of leaves, (path of keys, value). Layers are laid over one
another leaf by leaf, and what comes out is poured into the dataclasses below,
which declare names, defaults, rules and nesting.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import MISSING, dataclass, field, fields
from pathlib import Path, PurePosixPath
from typing import Any

# Layers, formats, policies and environments as sources and deployments name them.
LAYERS = ("bronze", "silver", "gold", "quarantine", "ops")
FORMATS = ("json", "csv", "parquet", "text")
POLICIES = ("rescue", "addNewColumns", "failOnNewColumns", "none")
ENVIRONMENTS = ("dev", "stg", "prd")

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}")

Leaves = Iterable[tuple[tuple[str, ...], Any]]


class SettingsError(ValueError):
    """Settings that are absent, unknown or contradict each other."""


def _is_relative(path: str) -> bool:
    return "://" not in path and not PurePosixPath(path).is_absolute() and ".." not in PurePosixPath(path).parts


class Ruled:
    """A dataclass whose RULES, (what must hold, what to say), are held when it is made."""

    RULES: tuple[tuple[Callable[[Any], bool], str], ...] = ()

    def __post_init__(self):
        for holds, said in self.RULES:
            if not holds(self):
                raise SettingsError(f"{getattr(self, 'name', type(self).__name__.lower())}: {said}")


@dataclass(frozen=True)
class Source(Ruled):
    """How one upstream system is read; its path is below the landing folder."""

    name: str
    format: str
    path: str
    contract: str
    policy: str = "rescue"
    max_files: int | None = None
    streaming: bool = False

    RULES = (
        (lambda s: s.format in FORMATS, "the format is unknown"),
        (lambda s: s.policy in POLICIES, "the policy is unknown"),
        (lambda s: s.max_files is None or s.max_files >= 1, "max_files must be positive"),
        (lambda s: _is_relative(s.path), "the path must be relative"),
    )


@dataclass(frozen=True)
class Quality(Ruled):
    """Objectives of a load, in percent of its rows and minutes."""

    warn_percent: float = 1.0
    fail_percent: float = 5.0
    null_key_percent: float = 0.0
    least_rows: int = 1
    freshness_minutes: int = 120

    RULES = (
        (lambda q: 0 <= q.warn_percent <= q.fail_percent <= 100, "0 <= warn_percent <= fail_percent <= 100 does not hold"),
        (lambda q: q.freshness_minutes > 0, "freshness_minutes must be positive"),
    )


def _variable(name: str, **more):
    """A field that the environment variable MILLRACE_<name> overrides."""
    return field(metadata={"variable": f"MILLRACE_{name}"}, **more)


@dataclass(frozen=True)
class Settings(Ruled):
    """One environment's settings."""

    environment: str
    catalog: str = _variable("CATALOG")
    landing: str = _variable("LANDING")
    checkpoints: str = _variable("CHECKPOINTS")
    scale: str = _variable("SCALE", default="small")
    continuous: bool = _variable("CONTINUOUS", default=False)
    sources: Mapping[str, Source] = field(default_factory=dict, metadata={"named": Source})
    quality: Quality = field(default_factory=Quality, metadata={"one": Quality})

    RULES = (
        (lambda s: s.environment in ENVIRONMENTS, "the environment is unknown"),
        (lambda s: bool(_NAME.fullmatch(s.catalog)), "the catalog is no identifier"),
    )

    def database(self, layer: str) -> str:
        """A layer's database: environments share none, as their catalogs differ."""
        if layer not in LAYERS:
            raise SettingsError(f"{layer} is no layer")
        return f"{self.catalog}_{layer}"

    def table(self, layer: str, name: str) -> str:
        """A table's full name."""
        if not _NAME.fullmatch(name):
            raise SettingsError(f"{layer}.{name} names no table")
        return f"{self.database(layer)}.{name}"

    def source(self, name: str) -> Source:
        if name not in self.sources:
            raise SettingsError(f"no source {name!r}; there are {', '.join(sorted(self.sources))}")
        return self.sources[name]

    def landing_path(self, name: str) -> str:
        return f"{self.landing.rstrip('/')}/{self.source(name).path}"

    def checkpoint_path(self, stream: str) -> str:
        """Environments never share a checkpoint."""
        if not _NAME.fullmatch(stream):
            raise SettingsError(f"{stream!r} names no stream")
        return f"{self.checkpoints.rstrip('/')}/{self.environment}/{stream}"

    def schema_path(self, stream: str) -> str:
        """Where the schemas that a stream was read by are kept, apart from its checkpoint."""
        return f"{self.checkpoint_path(stream)}-schema"


def _leaves(tree: Mapping[str, Any], at: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Any]]:
    for key, value in tree.items():
        if isinstance(value, Mapping) and value:
            yield from _leaves(value, (*at, key))
        else:
            yield (*at, key), value


def _tree(leaves: Leaves) -> dict[str, Any]:
    """The mapping of leaves; a later leaf replaces an earlier one, and whatever was below it."""
    out: dict[str, Any] = {}
    for path, value in leaves:
        here = out
        for key in path[:-1]:
            if not isinstance(here.get(key), dict):
                here[key] = {}
            here = here[key]
        if not (value == {} and isinstance(here.get(path[-1]), dict)):
            here[path[-1]] = value
    return out


def layered(low: Mapping[str, Any], high: Mapping[str, Any]) -> dict[str, Any]:
    """low with high on top: mappings are merged, anything else is replaced."""
    return _tree([*_leaves(low), *_leaves(high)])


def _of_file(path: Path) -> Leaves:
    import yaml

    try:
        found = yaml.safe_load(path.read_text())
    except FileNotFoundError as gone:
        raise SettingsError(f"{path} does not exist") from gone
    if not isinstance(found, dict | None):
        raise SettingsError(f"{path} is no mapping")
    return _leaves(found or {})


def _of_variables(variables: Mapping[str, str]) -> Leaves:
    for f in fields(Settings):
        text = variables.get(f.metadata.get("variable", ""))
        if text is not None:
            yield (f.name,), text.strip().lower() in ("1", "true", "yes") if f.type == "bool" else text


def _poured(kind, tree: Any, where: str, **given):
    """A dataclass from a mapping; what it does not declare, or lacks, is refused."""
    if not isinstance(tree, Mapping):
        raise SettingsError(f"{where} is no mapping")
    declared = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(tree) - set(declared)):
        raise SettingsError(f"{where}: unknown {', '.join(unknown)}")
    for name, f in declared.items():
        value = tree.get(name, MISSING)
        if value is MISSING:
            if f.default is MISSING and f.default_factory is MISSING and name not in given:
                raise SettingsError(f"{where}: {name} is missing")
        elif inner := f.metadata.get("one"):
            given[name] = _poured(inner, value, name)
        elif inner := f.metadata.get("named"):
            given[name] = {n: _poured(inner, v, n, name=n) for n, v in value.items()}
        else:
            given[name] = value
    return kind(**given)


def load(environment: str | None = None, folder: str | Path = "conf", overrides: Mapping[str, Any] | None = None, variables: Mapping[str, str] | None = None) -> Settings:
    """Settings of an environment (MILLRACE_ENVIRONMENT, else dev).

    MILLRACE_CATALOG, _LANDING, _CHECKPOINTS, _SCALE and _CONTINUOUS override the
    files, and `overrides` all of them. Unknown keys are refused.
    """
    variables = os.environ if variables is None else variables
    name = environment or variables.get("MILLRACE_ENVIRONMENT") or "dev"
    if name not in ENVIRONMENTS:
        raise SettingsError(f"environment {name!r} is none of {', '.join(ENVIRONMENTS)}")
    layers = (_of_file(Path(folder, "base.yml")), _of_file(Path(folder, f"{name}.yml")), _of_variables(variables), _leaves(overrides or {}))
    return _poured(Settings, _tree(leaf for layer in layers for leaf in layer), "settings", environment=name)
