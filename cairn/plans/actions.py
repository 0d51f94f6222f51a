"""Actions on a table, folded in order: what a command line asks for, as a plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame

from cairn.operators import filters
from cairn.operators.transform import euler_quaternion, transform


@dataclass(frozen=True)
class Translate:
    value: tuple[float, float, float]


@dataclass(frozen=True)
class Rotate:
    """Degrees about the fixed axes x, then y, then z."""

    value: tuple[float, float, float]


@dataclass(frozen=True)
class Scale:
    value: float


@dataclass(frozen=True)
class FilterNaN:
    pass


@dataclass(frozen=True)
class FilterByValue:
    column: str
    comparison: str
    value: float


@dataclass(frozen=True)
class FilterBands:
    value: int


@dataclass(frozen=True)
class FilterBox:
    lo: tuple[float, float, float]
    hi: tuple[float, float, float]


@dataclass(frozen=True)
class FilterSphere:
    center: tuple[float, float, float]
    radius: float


@dataclass(frozen=True)
class FilterRows:
    """Any condition on a row."""

    where: Column | Callable[[DataFrame], Column]


@dataclass(frozen=True)
class Param:
    name: str
    value: str


@dataclass(frozen=True)
class Lod:
    value: float


Action = Translate | Rotate | Scale | FilterNaN | FilterByValue | FilterBands | FilterBox | FilterSphere | FilterRows | Param | Lod


@dataclass
class Plan:
    actions: list[Action] = field(default_factory=list)
    params: dict[str, str] = field(default_factory=dict)

    def __call__(self, df: DataFrame) -> DataFrame:
        return reduce(self._apply, self.actions, df)

    def _apply(self, df: DataFrame, a: Action) -> DataFrame:
        match a:
            case Translate(v):
                return transform(df, translation=v)
            case Rotate(v):
                return transform(df, rotation=euler_quaternion(v))
            case Scale(v):
                return transform(df, scale=v)
            case FilterNaN():
                return filters.finite(df)
            case FilterByValue(c, k, v):
                return filters.by_value(df, c, k, v)
            case FilterBands(v):
                return filters.bands(df, v)
            case FilterBox(lo, hi):
                return filters.box(df, lo, hi)
            case FilterSphere(c, r):
                return filters.sphere(df, c, r)
            case FilterRows(w):
                return df.where(w(df) if callable(w) and not isinstance(w, Column) else w)
            case Param(n, v):
                self.params[n] = v
                return df
            case Lod(v):
                return filters.set_lod(df, v)
        raise TypeError(f"no such action: {a}")
