"""Curation: an ordered log of actions against a library, gated by verdicts that were computed beforehand.

A step depends on the library that the steps before it left, so an episode is
sequential; episodes are independent and run as one task group each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

# Action kinds and statuses.
KINDS = ("merge", "split", "parameterize", "modify", "add", "remove", "keep", "end")
STATUSES = ("applied", "rejected", "blocked", "invalid", "noop")
STRUCTURAL = ("merge", "split", "parameterize")
EDITABLE = ("name", "description", "default")
RESULT = "episode string, step int, kind string, status string, primary string, secondary string, reason string, size_before int, size_after int"


@dataclass
class Library:
    """ids in order, their trust, edits, usage, absorbed bindings; budget and what was taken of it."""

    skills: dict[str, dict[str, Any]]
    verdicts: dict[tuple[str, str], tuple[str, str]]
    budget: int = 100
    taken: int = 0
    hardened: bool = False
    used: dict[str, int] = field(default_factory=dict)
    history: list[dict[str, Any]] = field(default_factory=list)

    @property
    def budget_remaining(self) -> int:
        return max(0, self.budget - self.taken)

    def relation(self, a: str, b: str) -> tuple[str, str]:
        """Relation and direction seen from (a, b); pairs without a verdict are distinct."""
        if (a, b) in self.verdicts:
            return self.verdicts[a, b]
        r, d = self.verdicts.get((b, a), ("DISTINCT", "NONE"))
        return r, {"A_SUBSUMES_B": "B_SUBSUMES_A", "B_SUBSUMES_A": "A_SUBSUMES_B"}.get(d, d)

    def apply(self, action: dict[str, Any]) -> dict[str, Any]:
        """Every action but the end costs one of the budget, whatever comes of it."""
        before = len(self.skills)
        kind = action.get("kind", "")
        status, reason = ("invalid", f"unknown kind {kind!r}") if kind not in KINDS else getattr(self, f"_{kind}")(action)
        if kind != "end":
            self.taken += 1
        row = {"step": len(self.history), "kind": kind, "status": status, "primary": action.get("primary") or "", "secondary": action.get("secondary") or "", "reason": reason, "size_before": before, "size_after": len(self.skills)}
        self.history.append(row)
        return row

    def _known(self, *ids: str | None) -> str:
        missing = [str(i) for i in ids if i not in self.skills]
        return f"unknown: {', '.join(missing)}" if missing else ""

    def _pair(self, a: dict[str, Any]) -> tuple[str, str] | None:
        x, y = a.get("primary"), a.get("secondary")
        if why := self._known(x, y):
            return "invalid", why
        if x == y:
            return "invalid", "a function can't be paired with itself"
        if not (self.skills[x].get("trusted", True) and self.skills[y].get("trusted", True)):
            return "blocked", "untrusted functions aren't executed"
        return None

    def _merge(self, a: dict[str, Any]) -> tuple[str, str]:
        if bad := self._pair(a):
            return bad
        relation, _ = self.relation(a["primary"], a["secondary"])
        if relation not in ("EXACT", "PERCEPTUAL"):
            return "rejected", f"{relation} doesn't license a merge"
        self._fold(a["primary"], a["secondary"])
        return "applied", relation

    def _parameterize(self, a: dict[str, Any]) -> tuple[str, str]:
        if bad := self._pair(a):
            return bad
        relation, direction = self.relation(a["primary"], a["secondary"])
        if relation == "SUBSUMPTION" and direction != "B_SUBSUMES_A":
            return "rejected", "swap operands: the general function comes second"
        if relation not in ("SUBSUMPTION", "SEMANTIC_PRESERVING"):
            return "rejected", f"{relation} doesn't license parameterize"
        self.skills[a["secondary"]].setdefault("absorbed", {})[a["primary"]] = a.get("binding") or {}
        self._fold(a["primary"], a["secondary"])
        return "applied", relation

    def _fold(self, gone: str, into: str) -> None:
        self.used[into] = self.used.get(into, 0) + self.used.pop(gone, 0)
        del self.skills[gone]

    def _split(self, a: dict[str, Any]) -> tuple[str, str]:
        if why := self._known(a.get("primary")):
            return "invalid", why
        return "blocked", "pieces written by an agent aren't executed here"

    def _remove(self, a: dict[str, Any]) -> tuple[str, str]:
        if why := self._known(a.get("primary")):
            return "invalid", why
        del self.skills[a["primary"]]
        return "applied", f"used {self.used[a['primary']]} times" if self.used.get(a["primary"]) else ""

    def _modify(self, a: dict[str, Any]) -> tuple[str, str]:
        """Edits change the library and not the outputs that verdicts were made from."""
        if why := self._known(a.get("primary")):
            return "invalid", why
        if a.get("source"):
            return "blocked", "code written by an agent isn't executed here"
        edits = {k: a[k] for k in EDITABLE if a.get(k) is not None}
        if not edits:
            return "noop", "nothing to change"
        self.skills[a["primary"]].update(edits)
        return "applied", ", ".join(edits)

    def _add(self, a: dict[str, Any]) -> tuple[str, str]:
        if not a.get("primary") or a["primary"] in self.skills:
            return "invalid", "the id is missing or taken"
        self.skills[a["primary"]] = {"trusted": False, "description": a.get("description", "")}
        return "applied", "untrusted until reviewed"

    def _keep(self, a: dict[str, Any]) -> tuple[str, str]:
        return "noop", ""

    def _end(self, a: dict[str, Any]) -> tuple[str, str]:
        return "noop", ""

    def render(self, history: int = 8) -> str:
        """What an agent sees: no label of defects; descriptions of 80 characters, the last actions."""
        lines = [f"{len(self.skills)} functions, budget {self.budget_remaining}"]
        lines += [f"{i} used={self.used.get(i, 0)} {str(s.get('description', ''))[:80]}" for i, s in self.skills.items()]
        return "\n".join(lines + [f"{h['kind']} {h['primary']} {h['secondary']} -> {h['status']}" for h in self.history[-history:]])


def scripted(actions: list[dict[str, Any]]) -> Callable[[Library], dict[str, Any]]:
    """An agent that replays a list and then ends."""
    rest: Iterator[dict[str, Any]] = iter(actions)
    return lambda _: next(rest, {"kind": "end"})


def run_episode(library: Library, agent: Callable[[Library], dict[str, Any]], max_steps: int | None = None) -> list[dict[str, Any]]:
    """Up to the end, the budget or the number of steps."""
    while library.budget_remaining and (max_steps is None or len(library.history) < max_steps):
        if library.apply(agent(library))["kind"] == "end":
            break
    return library.history


def run_episodes(actions: DataFrame, skills: dict[str, dict[str, Any]], verdicts: dict[tuple[str, str], tuple[str, str]], budget: int = 100) -> DataFrame:
    """actions: episode, step, kind, primary, secondary. The results of all episodes, one task group each."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("step").to_dict("records")
        library = Library({k: dict(v) for k, v in skills.items()}, verdicts, budget)
        out = pd.DataFrame(run_episode(library, scripted(rows)))
        out.insert(0, "episode", key[0])
        return out

    return actions.groupBy("episode").applyInPandas(run, RESULT)
