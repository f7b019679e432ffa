"""Descriptions of steps in YAML, with variables: ``!var name`` is a value, ``!varstr text`` a template of values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import yaml

from weftline.errors import ConfigurationError


@dataclass(frozen=True)
class Var:
    value: str


@dataclass(frozen=True)
class VarStr(Var):
    pass


class _Loader(yaml.SafeLoader):
    pass


class _Dumper(yaml.SafeDumper):
    pass


for _tag, _kind in (("!var", Var), ("!varstr", VarStr)):
    _Loader.add_constructor(_tag, lambda loader, node, kind=_kind: kind(loader.construct_scalar(node)))
    _Dumper.add_representer(_kind, lambda dumper, value, tag=_tag: dumper.represent_scalar(tag, value.value))


def load(text: str) -> dict[str, Any]:
    """A description from YAML text."""
    found = yaml.load(text, Loader=_Loader)  # noqa: S506 - derived from the safe loader
    if not isinstance(found, dict):
        raise ConfigurationError("a mapping is expected")
    return found


def dump(value: Any) -> str:
    return yaml.dump(value, Dumper=_Dumper, sort_keys=False, allow_unicode=True)


def expand(value: Any, names: dict[str, Any]) -> Any:
    """``value`` with its variables replaced."""
    if isinstance(value, dict):
        return {expand(k, names): expand(v, names) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, names) for v in value]
    if isinstance(value, VarStr):
        try:
            return value.value.format(**names)
        except (KeyError, IndexError) as error:
            raise ConfigurationError(f"a template uses an unknown variable: {value.value}") from error
    if isinstance(value, Var):
        if value.value not in names:
            raise ConfigurationError(f"unknown variable: {value.value}")
        return names[value.value]
    return value


def substeps(step: dict[str, Any], constants: dict[str, Any]) -> Iterator[dict[str, Any]]:
    """A step's parameters, once for each position of its variables' lists; the step's own constants come first."""
    variables, names = step.get("variables") or {}, {**constants, **(step.get("constants") or {})}
    for key, values in variables.items():
        if not isinstance(values, list):
            raise ConfigurationError(f"variable {key} isn't a list")
    if len({len(v) for v in variables.values()}) > 1:
        raise ConfigurationError("variables have lists of different lengths")
    if not variables:
        yield expand(step.get("parameters") or {}, names)
        return
    for values in zip(*variables.values(), strict=True):
        yield expand(step.get("parameters") or {}, {**names, **dict(zip(variables, values, strict=True))})
