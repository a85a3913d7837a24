"""The model graph: names, join paths, inheritance."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from .model import DefinitionError, Explore, Metric, Model, Parameter, Relationship, SavedQuery


class AmbiguousJoinPath(DefinitionError):
    """Two shortest paths lead to a model and the query prefers neither."""


@dataclass(frozen=True)
class Hop:
    """A join from one model to the next. ``multiplies``: a left row may meet several right rows."""

    left: str
    right: str
    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]
    multiplies: bool
    condition: str | None = None  # with {from} and {to}
    how: str | None = None
    cross: bool = False


def _names(given: str | list[str] | None) -> tuple[str, ...]:
    return () if given is None else (given,) if isinstance(given, str) else tuple(given)


class Graph:
    def __init__(self):
        self.models: dict[str, Model] = {}
        self.metrics: dict[str, Metric] = {}
        self.parameters: dict[str, Parameter] = {}
        self.explores: dict[str, Explore] = {}
        self.saved: dict[str, SavedQuery] = {}
        self._hops: dict[str, list[Hop]] | None = None

    def add(self, model: Model) -> None:
        if model.name in self.models:
            raise DefinitionError(f"model {model.name} is there already")
        if model.extends:
            if model.extends not in self.models:
                raise DefinitionError(f"model {model.name} extends the unknown model {model.extends}")
            model = self.models[model.extends].extended_by(model)
        if not (model.table or model.sql or model.source_uri):
            raise DefinitionError(f"model {model.name} needs a table, sql or source_uri")
        for kind in ("dimensions", "metrics", "segments"):
            names = [x.name for x in getattr(model, kind)]
            if len(names) != len(set(names)):
                raise DefinitionError(f"model {model.name} names a member of {kind} twice")
        self.models[model.name] = model
        self._hops = None

    def add_metric(self, metric: Metric) -> None:
        if metric.name in self.metrics:
            raise DefinitionError(f"metric {metric.name} is there already")
        self.metrics[metric.name] = metric

    def model(self, name: str) -> Model:
        if name not in self.models:
            raise DefinitionError(f"no model {name}; there are {', '.join(sorted(self.models)) or 'none'}")
        return self.models[name]

    def find_metric(self, ref: str) -> tuple[str | None, Metric] | None:
        """(owner, metric) of ``model.metric``, a graph metric or the only model's metric so named."""
        if "." in ref:
            owner, name = ref.split(".", 1)
            found = self.models[owner].metric(name) if owner in self.models else None
            return (owner, found) if found else None
        if ref in self.metrics:
            return None, self.metrics[ref]
        owners = [m for m in self.models.values() if m.metric(ref)]
        if len(owners) > 1:
            raise DefinitionError(f"metric {ref} is in several models: {', '.join(m.name for m in owners)}")
        return (owners[0].name, owners[0].metric(ref)) if owners else None

    def hops(self) -> dict[str, list[Hop]]:
        if self._hops is None:
            found: dict[str, list[Hop]] = {name: [] for name in self.models}

            def both(hop: Hop, back_multiplies: bool) -> None:
                flip = {"left": "right", "right": "left"}.get(hop.how or "", hop.how)
                turned = hop.condition and hop.condition.replace("{from}", "\0").replace("{to}", "{from}").replace("\0", "{to}")
                found[hop.left].append(hop)
                found[hop.right].append(Hop(hop.right, hop.left, hop.right_keys, hop.left_keys, back_multiplies, turned, flip, hop.cross))

            for model in self.models.values():
                for r in model.relationships:
                    if r.active and r.name in self.models and (not r.through or r.through in self.models):
                        for hop, back in self._edges(model, r):
                            if len(hop.left_keys) == len(hop.right_keys):
                                both(hop, back)
            self._hops = {k: list({(h.right, h.left_keys, h.right_keys, h.condition): h for h in v}.values()) for k, v in found.items()}
        return self._hops

    def _edges(self, model: Model, r: Relationship) -> list[tuple[Hop, bool]]:
        other = self.models[r.name]
        if r.type == "cross":
            return [(Hop(model.name, r.name, (), (), True, cross=True), True)]
        if r.type in ("many_to_one", "one_to_one") or (r.type == "many_to_many" and not r.through):
            left = _names(r.foreign_key) or (() if r.sql else (f"{r.name}_id",))
            right = _names(r.primary_key) or tuple(other.key)
            if r.sql:
                left, right = (), ()
            many = r.type == "many_to_many"
            return [(Hop(model.name, r.name, left, right, many, r.sql, r.join_type), r.type != "one_to_one")]
        if r.type == "one_to_many":
            left = _names(r.primary_key) or tuple(model.key)
            right = _names(r.foreign_key) or (f"{model.name}_id",)
            if r.sql:
                left, right = (), ()
            return [(Hop(model.name, r.name, left, right, True, r.sql, r.join_type), False)]
        own = _names(r.through_foreign_key) or _names(r.foreign_key) or (f"{model.name}_id",)
        far = _names(r.related_foreign_key) or (f"{r.name}_id",)
        return [(Hop(model.name, r.through, tuple(model.key), own, True), False), (Hop(r.through, r.name, far, tuple(other.key), False), True)]

    def path(self, start: str, goal: str, preferred: frozenset[str] = frozenset()) -> list[Hop]:
        """The shortest join path; of several, the one with most hops to models of the query."""
        if start == goal:
            return []
        best: list[list[Hop]] = []
        queue: deque[list[Hop]] = deque([[]])
        seen = {start: 0}
        while queue:
            path = queue.popleft()
            if best and len(path) >= len(best[0]):
                break
            at = path[-1].right if path else start
            for hop in self.hops().get(at, ()):
                step = [*path, hop]
                if hop.right == goal:
                    best.append(step)
                elif seen.get(hop.right, len(step)) >= len(step) and all(hop.right != h.left for h in path) and hop.right != start:
                    seen[hop.right] = len(step)
                    queue.append(step)
        if not best:
            raise DefinitionError(f"no join path from {start} to {goal}")
        liked = [sum(h.right in preferred for h in p) for p in best]
        top = [p for p, n in zip(best, liked) if n == max(liked)]
        if len(top) > 1:
            raise AmbiguousJoinPath(f"{len(top)} equally short paths from {start} to {goal}")
        return top[0]
