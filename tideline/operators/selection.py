"""Which features a run computes: set algebra over groups, names and presets, and its files."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from tideline.model import FEATURES, GROUP_OF, PRESETS


@dataclass(frozen=True)
class Selection:
    """(features of groups, and features) without exclude.

    strict keeps names as written, so that a name with stray blanks selects
    nothing; otherwise names are stripped.
    """

    groups: tuple[str, ...] = ()
    features: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    strict: bool = False

    def names(self) -> list[str]:
        tidy = (lambda x: x) if self.strict else str.strip
        chosen = {f for g in self.groups for f in FEATURES.get(g, ())} | {tidy(f) for f in self.features}
        return sorted(chosen - {tidy(f) for f in self.exclude})

    def computable(self) -> list[str]:
        return [f for f in self.names() if f in GROUP_OF]

    def required_groups(self) -> list[str]:
        need = {GROUP_OF[f] for f in self.computable()}
        return [g for g in FEATURES if g in need]

    def __add__(self, other: Selection) -> Selection:
        return Selection(self.groups + other.groups, self.features + other.features, self.exclude + other.exclude, self.strict or other.strict)


def preset(name: str, strict: bool = False) -> Selection:
    if name not in PRESETS:
        raise KeyError(f"unknown preset {name!r}; there are {sorted(PRESETS)}")
    return Selection(*PRESETS[name], strict=strict)


def resolve(requested: list[str] | None) -> Selection:
    """Names of features or groups, mixed; an unknown single name is an error, nothing means all."""
    if not requested:
        return Selection(groups=tuple(FEATURES))
    groups = tuple(r for r in requested if r in FEATURES)
    names = tuple(r for r in requested if r not in FEATURES)
    if unknown := [n for n in names if n not in GROUP_OF]:
        raise ValueError(f"unknown features: {unknown}")
    return Selection(groups=groups, features=names)


def load(path: str) -> Selection:
    """A selection from a YAML or JSON file with groups, features and exclude."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        spec = json.loads(text)
    else:
        import yaml

        spec = yaml.safe_load(text)
    spec = spec or {}
    return Selection(*(tuple(spec.get(k) or ()) for k in ("groups", "features", "exclude")))


def save_example(path: str) -> None:
    spec = {"groups": ["time_domain", "frequency_domain"], "features": ["de_alpha"], "exclude": ["spectral_entropy"]}
    if path.endswith(".json"):
        Path(path).write_text(json.dumps(spec, indent=2))
    else:
        import yaml

        Path(path).write_text(yaml.safe_dump(spec, sort_keys=False))
