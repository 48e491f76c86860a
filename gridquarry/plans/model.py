"""Arrays, decision variables, relaxable constraints and configuration.

An N-d array is a DataFrame with a long column for each dimension and a column for each attribute. An empty cell is a
row that is not there; a NULL attribute is a row whose value is null. NaN counts as missing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dim:
    """An integer dimension lo..hi stored in tiles of ``chunk``."""

    name: str
    lo: int
    hi: int
    chunk: int = 1


@dataclass(frozen=True)
class ArrayMeta:
    name: str
    dims: tuple[Dim, ...]
    attrs: tuple[str, ...]

    def dim(self, name: str) -> Dim:
        return next(d for d in self.dims if d.name == name)


@dataclass
class Array:
    """A DataFrame with the metadata of the array it holds."""

    meta: ArrayMeta
    cells: DataFrame


@dataclass(frozen=True)
class Domain:
    """Values of an integer decision variable: lo, lo + step, … up to hi."""

    lo: int
    hi: int
    step: int = 1

    @property
    def last(self) -> int:
        return self.lo + (self.hi - self.lo) // self.step * self.step if self.hi >= self.lo else self.lo - self.step

    def values(self) -> range:
        return range(self.lo, self.hi + 1, self.step)

    def slices(self, n: int) -> list[Domain]:
        """The domain cut into at most ``n`` consecutive parts."""
        vals = self.values()
        per = -(-len(vals) // max(1, n)) or 1
        return [Domain(vals[k], vals[min(k + per, len(vals)) - 1], self.step) for k in range(0, len(vals), per)]


@dataclass(frozen=True)
class Span:
    """A region along one axis of a window with origin o and length n: from o + a + b n, of length c + d n."""

    a: int = 0
    b: int = 0
    c: int = 0
    d: int = 1


@dataclass(frozen=True)
class Axis:
    """One dimension of a window search: where windows begin and how long they are; they end by ``end``."""

    dim: str
    origin: Domain
    length: Domain
    end: int
    length_name: str = ""

    @property
    def length_col(self) -> str:
        return self.length_name or f"l{self.dim}"


@dataclass(frozen=True)
class Relaxable:
    """An interval constraint l <= value <= h that may be widened to max_l..max_h; limits never tighten it.

    ``contract``: 0 takes no part in contraction, 1 is maximised, any other number minimised; ``rank_l``, ``rank_h`` are
    the interval over which a value is ranked.
    """

    name: str
    l: float | None  # noqa: E741
    h: float | None
    max_l: float | None = None
    max_h: float | None = None
    contract: int = 0
    strict: bool = False
    rank_l: float | None = None
    rank_h: float | None = None

    def __post_init__(self) -> None:
        for side, limit, tight in (("max_l", self.l, min), ("max_h", self.h, max)):
            given = getattr(self, side)
            if limit is not None:
                object.__setattr__(self, side, limit if given is None else tight(given, limit))

    def holds(self, value: Column) -> Column:
        ok = F.lit(True)
        if self.l is not None:
            ok &= (value > self.l) if self.strict else (value >= self.l)
        if self.h is not None:
            ok &= value <= self.h
        return ok

    def holds_relaxed(self, value: Column) -> Column:
        ok = F.lit(True)
        if self.max_l is not None:
            ok &= value >= self.max_l
        if self.max_h is not None:
            ok &= value <= self.max_h
        return ok

    def gap(self, value: Column) -> Column:
        """Distance from the value to the interval; 0 inside."""
        parts = [F.lit(0.0)]
        if self.l is not None:
            parts.append(F.lit(float(self.l)) - value)
        if self.h is not None:
            parts.append(value - F.lit(float(self.h)))
        return F.greatest(*parts) if len(parts) > 1 else parts[0]

    def distance(self, value: Column) -> Column:
        """The gap as a share of the widest relaxation on its side; a side without room counts fully."""
        out = F.lit(0.0)
        if self.h is not None:
            room = float(self.max_h - self.h)
            out = F.when(value > self.h, (value - self.h) / room if room else F.lit(1.0)).otherwise(out)
        if self.l is not None:
            room = float(self.l - self.max_l)
            out = F.when(value < self.l, (F.lit(float(self.l)) - value) / room if room else F.lit(1.0)).otherwise(out)
        return out


@dataclass
class Config:
    """A JSON tree addressed by dotted paths."""

    tree: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path) as f:
            return cls(json.load(f))

    def get(self, path: str, default: Any = None) -> Any:
        node: Any = self.tree
        for part in path.split("."):
            if not isinstance(node, dict) or part not in node:
                return default
            node = node[part]
        return node

    def need(self, path: str) -> Any:
        found = self.get(path)
        if found is None:
            raise ValueError(f"the configuration lacks {path}")
        return found

    def set(self, path: str, value: Any) -> Config:
        *parents, last = path.split(".")
        node = self.tree
        for part in parents:
            node = node.setdefault(part, {})
        node[last] = value
        return self

    def num(self, path: str, default: Any = None) -> Any:
        """A number, also where the file has it as text; whole where it can be."""
        found = self.get(path, default)
        if isinstance(found, str):
            found = float(found)
        return int(found) if isinstance(found, float) and found.is_integer() else found

    def flag(self, path: str, default: bool = False) -> bool:
        found = self.get(path, default)
        return found.strip().lower() in ("1", "true", "yes") if isinstance(found, str) else bool(found)
