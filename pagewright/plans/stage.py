"""Stages and pipelines: named DataFrame transformations with parameters, conditions and an error contract.

A pipeline gives rows that have none a place in ``_ord`` for as long as it works, drops what is disabled while it is built, and checks that each stage's
input columns are there. A stage with a condition works on the rows that meet it; the others go round it untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import compile_condition, validate
from ..schemas import empty
from .errors import ConfigError

ORDER = "_ord"
BASE = {"inputCol": "content", "outputCol": "output", "pathCol": "path", "pageCol": "page", "keepInputData": False, "propagateError": False}


@dataclass
class Run:
    """What a run is given: variables of conditions, engines by name, stages to switch by id or name."""

    variables: Mapping = field(default_factory=dict)
    engines: Mapping = field(default_factory=dict)
    enabled: Mapping[str, bool] = field(default_factory=dict)


def resolve(defaults: Mapping, options: Mapping, checks: Mapping[str, Callable] | None = None) -> dict:
    """Defaults with the options that are given (None counts as not given); unknown names and bad values are refused."""
    known = {**BASE, **defaults}
    unknown = set(options) - set(known)
    if unknown:
        raise ConfigError(f"unknown options {sorted(unknown)}")
    out = {**known, **{k: v for k, v in options.items() if v is not None}}
    for name, check in (checks or {}).items():
        check(name, out[name])
    return out


def in_range(low: float, high: float) -> Callable:
    def check(name: str, value) -> None:
        if not low <= value <= high:
            raise ValueError(f"{name} must be within [{low}, {high}], not {value}")

    return check


def positive_int(name: str, value) -> None:
    if not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive integer, not {value}")


class Stage:
    """Subclass and give ``name``, ``defaults``, ``kind`` and ``apply``; override ``transform`` for anything but a map."""

    name = "Stage"
    defaults: Mapping = {}
    checks: Mapping[str, Callable] = {}
    kind = "document"
    expands = False
    barrier = False

    def __init__(self, id: str | None = None, when: Mapping | None = None, enabled: bool = True, **options):
        self.options = dict(options)
        self.params = resolve(self.defaults, options, self.checks)
        self.id, self.when, self.enabled = id, validate(when) if when is not None else None, enabled

    def reads(self) -> list[str]:
        return list(dict.fromkeys(self.params.get("inputCols") or [self.params["inputCol"]]))

    def writes(self) -> list[str]:
        return [self.params["outputCol"]]

    def apply(self, df: DataFrame, run: Run) -> Column:
        """The output column of a map stage."""
        raise NotImplementedError

    def failure(self, message: str) -> Column:
        return empty(self.kind, exception=F.lit(message))

    def transform(self, df: DataFrame, run: Run) -> DataFrame:
        return df.withColumn(self.params["outputCol"], self.apply(df, run))

    def run(self, df: DataFrame, run: Run | None = None) -> DataFrame:
        run = run or Run()
        missing = [c for c in self.reads() if c not in df.columns]
        if missing:
            raise ConfigError(f"{self.id or self.name} reads columns that are not there: {missing}")
        if self.when is None:
            return self._drop(self.transform(df, run))
        meets = compile_condition(self.when, df.schema, run.variables)
        done = self._drop(self.transform(df.where(meets), run))
        return done.unionByName(df.where(~meets), allowMissingColumns=True)

    def _drop(self, df: DataFrame) -> DataFrame:
        own = self.params["inputCol"]
        return df if self.params["keepInputData"] or own == self.params["outputCol"] else df.drop(own)

    def describe(self) -> dict:
        out: dict = {"type": self.name, "options": dict(self.options)}
        for key, value in (("id", self.id), ("when", self.when)):
            if value is not None:
                out[key] = value
        return out | ({} if self.enabled else {"enabled": False})


class Pipeline:
    def __init__(self, stages: Sequence[Stage]):
        self.stages = list(stages)
        seen: dict[str, int] = {}
        self.ids: list[str] = []
        repeated = {s.name for s in stages if sum(t.name == s.name and t.id is None for t in stages) > 1}
        for s in self.stages:
            n = seen.get(s.name, 0)
            seen[s.name] = n + 1
            self.ids.append(s.id or (f"{s.name}#{n}" if s.name in repeated else s.name))
        if len(set(self.ids)) != len(self.ids):
            raise ConfigError(f"stage ids must be unique: {self.ids}")

    def active(self, run: Run) -> list[Stage]:
        return [s for s, i in zip(self.stages, self.ids, strict=True) if run.enabled.get(i, run.enabled.get(s.name, s.enabled))]

    def transform(self, df: DataFrame, run: Run | None = None, ordered: bool = False) -> DataFrame:
        """All stages in turn. ``ordered``: sort the result by the rows' places and leave these out."""
        run = run or Run()
        out = df if ORDER in df.columns else df.withColumn(ORDER, F.array(F.monotonically_increasing_id()))
        for stage in self.active(run):
            out = stage.run(out, run)
        out = out.orderBy(ORDER) if ordered else out
        return out if ORDER in df.columns and not ordered else out.drop(ORDER)

    def plan(self, run: Run | None = None) -> dict:
        """Ids that run, the ids that need all rows at once, and those that split a row into pages or parts."""
        run = run or Run()
        on = self.active(run)
        name = dict(zip(map(id, self.stages), self.ids, strict=True))
        return {"stages": [name[id(s)] for s in on], "barriers": [name[id(s)] for s in on if s.barrier], "expands": [name[id(s)] for s in on if s.expands]}

    def describe(self) -> list[dict]:
        return [s.describe() for s in self.stages]


def place(df: DataFrame, nth: Column) -> DataFrame:
    """The place of a row that came from another one: the other's place and its number."""
    return df.withColumn(ORDER, F.concat(F.col(ORDER), F.array(nth.cast("long")))) if ORDER in df.columns else df


def unused(name: str, taken: Sequence[str]) -> str:
    """The name, with as many underscores before it as it takes to clash with no other."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name
