"""Features of a direction as a graph: what each is made of, so that a model gets the ones it names and no others.

A frame is a table that columns are made from, built from other frames; a feature is a column over the frames it names
and over other features.  ``plan`` walks from the wanted names down and gives what is needed, each after what it is made
of; nothing else is built, joined or read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Frame:
    """``build(inputs, *needed frames)``; joined to the rows on ``on``, to each of them where that is empty, never where it is None."""

    build: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    on: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Feature:
    """``column(inputs)`` over the columns of ``frames`` and the values of other ``features``."""

    column: Callable[[Any], Column]
    frames: tuple[str, ...] = ()
    features: tuple[str, ...] = ()


@dataclass
class FeatureGraph:
    """Frames and features by name; ``rows`` is the frame with a row for each unit, ``key`` its id."""

    direction: str
    rows: str
    key: str = "facility_id"
    frames: dict[str, Frame] = field(default_factory=dict)
    features: dict[str, Feature] = field(default_factory=dict)

    def frame(self, name: str, *needs: str, on: Sequence[str] | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        if name in self.frames:
            raise ValueError(f"{self.direction} has a frame {name}")

        def keep(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.frames[name] = Frame(build, needs, None if on is None else tuple(on))
            return build

        return keep

    def add(self, columns: Mapping[str, Callable[[Any], Column]], frames: Sequence[str] = (), features: Sequence[str] = ()) -> None:
        """Features over the same frames; a name that is taken is refused."""
        if taken := sorted(set(columns) & set(self.features)):
            raise ValueError(f"{self.direction} has {', '.join(taken)}")
        self.features.update({n: Feature(c, tuple(frames), tuple(features)) for n, c in columns.items()})

    def missing(self, names: Iterable[str]) -> list[str]:
        return [n for n in names if n not in self.features]

    def require(self, names: Iterable[str]) -> None:
        if absent := self.missing(names):
            raise LookupError(f"{self.direction} cannot make {', '.join(absent)}")

    def plan(self, names: Sequence[str]) -> tuple[list[str], list[str]]:
        """The frames and the features to make, in order."""
        self.require(names)
        frames: list[str] = []
        features: list[str] = []
        open_: list[tuple[str, str]] = []

        def visit(kind: str, name: str) -> None:
            done, known = (frames, self.frames) if kind == "frame" else (features, self.features)
            if name in done:
                return
            if (kind, name) in open_:
                raise ValueError(f"{self.direction}: {name} is made of itself")
            if name not in known:
                raise LookupError(f"{self.direction} has no {kind} {name}, which {open_[-1][1]} needs")
            open_.append((kind, name))
            for n in known[name].needs if kind == "frame" else known[name].frames:
                visit("frame", n)
            for n in () if kind == "frame" else known[name].features:
                visit("feature", n)
            open_.pop()
            done.append(name)

        visit("frame", self.rows)
        for n in names:
            visit("feature", n)
        return frames, features

    def build(self, inputs: Any, names: Sequence[str] | None = None) -> DataFrame:
        """Key and the named features, in their order; all of them without names."""
        names = list(self.features) if names is None else list(names)
        frames, features = self.plan(names)
        made: dict[str, DataFrame] = {}
        for n in frames:
            made[n] = self.frames[n].build(inputs, *(made[m] for m in self.frames[n].needs))
        out = made[self.rows]
        used = {f for n in features for f in self.features[n].frames}
        for n in frames:
            on = self.frames[n].on
            if n not in used or on is None:
                continue
            # a frame of one row is joined on a constant
            out = out.join(made[n], list(on), "left") if on else out.withColumn("_one", F.lit(1)).join(F.broadcast(made[n].withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
        waiting, ready = list(features), set()
        while waiting:
            now = [n for n in waiting if set(self.features[n].features) <= ready]
            out = out.withColumns({f"_f_{n}": self.features[n].column(inputs) for n in now})
            ready |= set(now)
            waiting = [n for n in waiting if n not in ready]
        return out.select(self.key, *[F.col(f"_f_{n}").alias(n) for n in names])


def value(name: str) -> Column:
    """Another feature's value, inside a feature's column."""
    return F.col(f"_f_{name}")
