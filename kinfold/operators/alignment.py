"""Which parameter values of two functions belong together, and where to look for one inside the other."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..functions.images import Skill
from .execute import params_key
from .planning import param_grid

Params = dict[str, Any]


@dataclass(frozen=True)
class Member:
    """A function on an axis: ``param`` follows the axis value times ``scale`` beside ``fixed`` ones, or ``bindings`` lists parameters by value."""

    param: str | None = None
    scale: float = 1.0
    fixed: Params = field(default_factory=dict)
    bindings: dict[str, Params] | None = None

    def __post_init__(self) -> None:
        if (self.param is None) == (self.bindings is None):
            raise ValueError("a member has either a parameter that follows the axis or bindings")

    def params_for(self, value: float) -> Params | None:
        if self.bindings is not None:
            return self.bindings.get(f"{float(value):g}")
        driven = value * self.scale
        return {**self.fixed, self.param: int(driven) if isinstance(value, int) and driven == int(driven) else driven}


@dataclass(frozen=True)
class Axis:
    name: str
    values: tuple[float, ...]
    members: dict[str, Member]

    def __post_init__(self) -> None:
        if not self.values or not self.members:
            raise ValueError(f"axis {self.name!r} needs values and members")

    def has(self, skill: str) -> bool:
        return skill in self.members

    def grid(self, skill: str) -> list[Params]:
        return [p for v in self.values if (p := self.members[skill].params_for(v)) is not None]

    def matched(self, a: str, b: str) -> Iterator[tuple[float, Params, Params]]:
        for v in self.values:
            x, y = self.members[a].params_for(v), self.members[b].params_for(v)
            if x is not None and y is not None:
                yield v, x, y


@dataclass(frozen=True)
class Alignment:
    axes: tuple[Axis, ...] = ()
    grids: dict[str, tuple[Params, ...]] = field(default_factory=dict)

    def axes_with(self, skill: str) -> list[Axis]:
        return [x for x in self.axes if x.has(skill)]

    def axis_for_pair(self, a: str, b: str) -> Axis | None:
        return next((x for x in self.axes if x.has(a) and x.has(b)), None)

    def grid_for(self, skill: str) -> list[Params]:
        """Bindings of all axes of a function, each once."""
        return list({params_key(p): p for x in self.axes_with(skill) for p in x.grid(skill)}.values())

    def subsumption_grid(self, skill: Skill) -> list[Params]:
        """The listed grid, or up to 24 sampled bindings, or the defaults alone."""
        if skill.id in self.grids:
            return list(self.grids[skill.id])
        specs = [{"name": p.name, "type": p.type, "default": p.default, "min": p.min, "max": p.max, "choices": p.choices} for p in skill.params]
        return param_grid(specs, 24) if specs else [{}]

    def sweep(self, a: str, b: str) -> list[tuple[Params, Params]]:
        """Matched bindings along the first axis that has both, or the defaults."""
        axis = self.axis_for_pair(a, b)
        return [(x, y) for _, x, y in axis.matched(a, b)] if axis else [({}, {})]

    def table(self, spark: SparkSession) -> DataFrame:
        """axis_pos, axis, value_pos, value, skill, params (JSON): what :func:`planning.matched_sweep` joins."""
        rows = [(i, x.name, j, float(v), s, params_key(p)) for i, x in enumerate(self.axes) for j, v in enumerate(x.values) for s, m in x.members.items() if (p := m.params_for(v)) is not None]
        return spark.createDataFrame(rows, "axis_pos int, axis string, value_pos int, value double, skill string, params string")


def load_alignment(path: str) -> Alignment:
    """From YAML: ``axes`` (name, values, members) and ``subsumption_grids`` (function to bindings)."""
    data = yaml.safe_load(Path(path).read_text()) or {}
    axes = []
    for x in data.get("axes", []):
        members = {s: Member(m.get("param"), float(m.get("scale", 1.0)), m.get("fixed", {}), {f"{float(k):g}": v for k, v in m["bindings"].items()} if "bindings" in m else None) for s, m in x["members"].items()}
        axes.append(Axis(x["name"], tuple(x["values"]), members))
    return Alignment(tuple(axes), {s: tuple(g) for s, g in data.get("subsumption_grids", {}).items()})
