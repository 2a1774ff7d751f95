"""Run parameters: a YAML tree with included files, overrides by band, checks of sampling groups."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from typing import Any

import yaml


class Parameters(dict):
    """A mapping whose keys are attributes too; ``_name`` is its key in the tree."""

    def __getattr__(self, key: str) -> Any:
        try:
            return self[key]
        except KeyError:
            raise AttributeError(key) from None


def _tree(value: Any, name: str = "") -> Any:
    if isinstance(value, Mapping):
        return Parameters({k: _tree(v, str(k)) for k, v in value.items()} | {"_name": name})
    return [_tree(v) for v in value] if isinstance(value, list) else value


def load(path: str | Path) -> Parameters:
    """Parameters of a file; ``!inc other.yml`` stands for another file, relative to the one that names it."""
    path = Path(path)

    class Loader(yaml.SafeLoader):
        pass

    def include(loader: yaml.SafeLoader, node: yaml.ScalarNode) -> Any:
        return load(path.parent / loader.construct_scalar(node))

    Loader.add_constructor("!inc", include)
    return _tree(yaml.load(path.read_text(), Loader) or {})  # noqa: S506


def resolve(key: str, *levels: Mapping[str, Any] | None, default: Any = None) -> Any:
    """The first level that has the key: band before general before *default*."""
    return next((x[key] for x in levels if x is not None and key in x), default)


def check_keys(block: Mapping[str, Any], known: set[str]) -> None:
    """An unknown key is an error that names it, so that a misspelt override is never silent."""
    unknown = sorted(k for k in block if k not in known and not k.startswith("_"))
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(unknown)}; known are {', '.join(sorted(known))}")


def check_groups(groups: Mapping[str, Mapping[str, Any]], components: set[str], bands: set[str]) -> dict[str, tuple[list[str], list[str]]]:
    """(components, bands) of each sampling group; omitted or "all" selects all, unknown names are errors."""
    out = {}
    for name, group in groups.items():
        if name.startswith("_"):
            continue
        chosen = []
        for key, known in (("components", components), ("bands", bands)):
            asked = group.get(key, "all")
            asked = sorted(known) if asked == "all" else list(asked)
            if unknown := sorted(set(asked) - known):
                raise ValueError(f"group {name}: unknown {key} {', '.join(unknown)}")
            chosen.append(asked)
        out[name] = (chosen[0], chosen[1])
    return out


def check_tiers(amplitudes: Mapping[str, tuple[list[str], list[str]]], spectral: Mapping[str, Mapping[str, Any]]) -> None:
    """A spectral group may couple to amplitude groups that exist, and to no other."""
    for name, group in spectral.items():
        if missing := sorted(set(group.get("resolve", [])) - set(amplitudes)):
            raise ValueError(f"group {name}: no amplitude groups {', '.join(missing)}")


def transfer_of(detector: Mapping[str, Any], default: Mapping[str, Any] | None) -> Mapping[str, Any] | None:
    """A detector's own time constant, else its transfer block, else the global default."""
    if "tau" in detector:
        return {"kind": "single_pole", "tau": detector["tau"]}
    return detector.get("transfer", default)


def views(bands: Mapping[str, str], workers: int) -> list[list[tuple[str, str]]]:
    """(band, polarisation view) pairs dealt to workers in turn; an IQU band has two views."""
    every = [(b, v) for b, pol in bands.items() for v in {"IQU": ("I", "QU")}.get(pol, (pol,))]
    return [every[k::workers] for k in range(workers)]
