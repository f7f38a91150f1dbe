"""Named, registered DataFrame steps and pipelines of them that can be saved as JSON and read again."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY: dict[str, type[Step]] = {}


def register(name: str):
    def add(cls):
        if name in REGISTRY:
            raise ValueError(f"step name taken: {name}")
        REGISTRY[name] = cls
        cls.step_name = name
        return cls

    return add


class Step:
    """A step maps a DataFrame to a DataFrame. Its keyword arguments are its configuration and are JSON values."""

    step_name = ""

    def __init__(self, **config):
        self.config = config

    def __call__(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def contract(self, schema: T.StructType, spark) -> T.StructType:
        """The schema that the step gives for a schema; no data is read."""
        return self(spark.createDataFrame([], schema)).schema


class Pipeline:
    """Steps in order, with hooks before and after each. Indexing gives a step, slicing a pipeline."""

    def __init__(self, steps: Iterable[Step], name: str = "pipeline"):
        self.steps, self.name = list(steps), name
        self.before: list[Callable[[int, DataFrame], None]] = []
        self.after: list[Callable[[int, DataFrame], None]] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        for _, out in self.stepwise(df):
            df = out
        return df

    def stepwise(self, df: DataFrame):
        """(step, its output), one at a time."""
        for i, step in enumerate(self.steps):
            for hook in self.before:
                hook(i, df)
            df = df.transform(step)
            for hook in self.after:
                hook(i, df)
            yield step, df

    def __len__(self) -> int:
        return len(self.steps)

    def __getitem__(self, at):
        return Pipeline(self.steps[at], self.name) if isinstance(at, slice) else self.steps[at]

    def contract(self, schema: T.StructType, spark) -> T.StructType:
        for step in self.steps:
            schema = step.contract(schema, spark)
        return schema

    def dumps(self) -> str:
        return json.dumps({"name": self.name, "steps": [{"step": s.step_name, "config": s.config} for s in self.steps]}, sort_keys=True)

    @classmethod
    def loads(cls, text: str, overrides: dict[str, dict] | None = None) -> Pipeline:
        """From dumps(); overrides change configurations by step name. An unknown step or override fails."""
        saved, overrides = json.loads(text), dict(overrides or {})
        steps = []
        for s in saved["steps"]:
            if s["step"] not in REGISTRY:
                raise KeyError(f"unknown step: {s['step']}")
            steps.append(REGISTRY[s["step"]](**s["config"] | overrides.pop(s["step"], {})))
        if overrides:
            raise KeyError(f"no such steps: {sorted(overrides)}")
        return cls(steps, saved["name"])


def load_plugins(modules: Iterable[str]) -> None:
    """Imports modules for the steps that they register."""
    for m in modules:
        importlib.import_module(m)


@register("rename")
class Rename(Step):
    """config: columns {old: new}; columns that are absent are left out."""

    def __call__(self, df):
        return df.withColumnsRenamed({a: b for a, b in self.config["columns"].items() if a in df.columns})


@register("drop")
class Drop(Step):
    def __call__(self, df):
        return df.drop(*self.config["columns"])


@register("numeric_only")
class NumericOnly(Step):
    """Keeps numbers, booleans and arrays of numbers, and the columns in config keep."""

    def __call__(self, df):
        number = lambda t: isinstance(t, (T.NumericType, T.BooleanType)) or isinstance(t, T.ArrayType) and number(t.elementType)
        return df.select(*[F.col(f"`{f.name}`") for f in df.schema.fields if number(f.dataType) or f.name in self.config.get("keep", [])])


@register("normalize")
class Normalize(Step):
    """config: column, and mean with std or min with max; mean and std go first where both are there."""

    def __call__(self, df):
        from framegrain.operators import stats

        c = self.config
        if "mean" in c:
            return df.withColumn(c["column"], stats.standardise(F.col(c["column"]), c["mean"], c["std"]))
        return df.withColumn(c["column"], stats.scale_minmax(F.col(c["column"]), c["min"], c["max"]))


@register("unnormalize")
class Unnormalize(Step):
    def __call__(self, df):
        from framegrain.operators import stats

        c = self.config
        if "mean" in c:
            return df.withColumn(c["column"], stats.unstandardise(F.col(c["column"]), c["mean"], c["std"]))
        return df.withColumn(c["column"], stats.unscale_minmax(F.col(c["column"]), c["min"], c["max"]))


@register("override_action")
class OverrideAction(Step):
    """The intervention's action where the flag is set."""

    def __call__(self, df):
        c = {"action": "action", "other": "action_intervention", "flag": "is_intervention"} | self.config
        return df.withColumn(c["action"], F.when(F.col(c["flag"]), F.col(c["other"])).otherwise(F.col(c["action"])))


@register("expand_action")
class ExpandAction(Step):
    """A compact vector to `size` channels: config enabled lists the places of its channels, the rest is 0."""

    def __call__(self, df):
        c = self.config
        places = {p: i for i, p in enumerate(c["enabled"])}
        full = F.array(*[F.coalesce(F.get(c["column"], F.lit(places[k])), F.lit(0.0)) if k in places else F.lit(0.0) for k in range(c["size"])])
        return df.withColumn(c["column"], full)


@register("compact_action")
class CompactAction(Step):
    def __call__(self, df):
        c = self.config
        return df.withColumn(c["column"], F.array(*[F.get(c["column"], F.lit(k)) for k in c["enabled"]]))


@register("finite")
class Finite(Step):
    def __call__(self, df):
        from framegrain.streaming.operators import finite

        return df.filter(finite(self.config["columns"]))
