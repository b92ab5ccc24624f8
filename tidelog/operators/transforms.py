"""Transforms of events: functions from DataFrame to DataFrame over map images."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

Transform = Callable[[DataFrame], DataFrame]


def identity(df: DataFrame) -> DataFrame:
    return df


def chained(*transforms: Transform) -> Transform:
    """The transforms in order; one that fails ends the chain with its error."""
    return lambda df: reduce(lambda d, t: d.transform(t), transforms, df)


def _has(image: str) -> Column:
    return F.size(F.coalesce(F.col(image), F.create_map().cast("map<string,string>"))) > 0


def _with_field(image: Column, name: str, value: Column) -> Column:
    """The image with the field set, replacing one of that name."""
    return F.map_concat(F.map_filter(image, lambda k, _: k != name), F.create_map(F.lit(name), value.cast("string")))


def _both(change: Callable[[Column], Column]) -> Transform:
    def apply(df: DataFrame) -> DataFrame:
        return df.withColumns({side: F.when(_has(side), change(F.col(side))).otherwise(F.col(side)) for side in ("before", "after") if side in df.columns})

    return apply


def _after(change: Callable[[Column], Column]) -> Transform:
    return lambda df: df.withColumn("after", F.when(_has("after"), change(F.col("after"))).otherwise(F.col("after")))


def mapped(names: Mapping[str, str], converters: Mapping[str, Callable[[Column], Column]] | None = None, static: Mapping[str, str] | None = None) -> Transform:
    """Renames fields of both images, after converting them by their old names.

    A converter returns null where it fails on a value; the field then keeps its
    old name and value.  Static fields are added to non-empty after images.  Two
    fields that would get one name are refused.
    """
    converters, static = dict(converters or {}), dict(static or {})
    if len(set(names.values())) < len(names):
        raise ValueError("two fields would get one name")

    def change(image: Column) -> Column:
        entries = F.map_entries(image)

        def entry(e: Column) -> Column:
            name = F.coalesce(*[F.when(e["key"] == old, F.lit(new)) for old, new in names.items()], e["key"]) if names else e["key"]
            value, failed = e["value"], F.lit(False)
            for old, convert in converters.items():
                own = e["key"] == old
                value = F.when(own & convert(e["value"]).isNotNull(), convert(e["value"])).otherwise(value)
                failed = failed | (own & convert(e["value"]).isNull() & e["value"].isNotNull())
            return F.struct(F.when(failed, e["key"]).otherwise(name).alias("key"), value.cast("string").alias("value"))

        # a kept field whose name another takes gives way
        taken = F.array(*[F.lit(n) for o, n in names.items() if o != n]) if names else F.array().cast("array<string>")
        present = F.transform(entries, lambda e: e["key"])
        sources = {n: o for o, n in names.items() if o != n}
        clash = lambda e: F.array_contains(taken, e["key"]) & reduce(lambda a, b: a | b, [(e["key"] == n) & F.array_contains(present, o) for n, o in sources.items()], F.lit(False)) & ~e["key"].isin(*names)
        kept = F.filter(entries, lambda e: ~clash(e)) if sources else entries
        return F.map_from_entries(F.transform(kept, entry))

    def apply(df: DataFrame) -> DataFrame:
        out = _both(change)(df)
        for name, value in static.items():
            out = _after(lambda image, n=name, v=value: _with_field(image, n, F.lit(v)))(out)
        return out

    return apply


def add_field(name: str, value: str) -> Transform:
    return _after(lambda image: _with_field(image, name, F.lit(value)))


def remove_field(name: str) -> Transform:
    return _both(lambda image: F.map_filter(image, lambda k, _: k != name))


def rename_field(old: str, new: str) -> Transform:
    return mapped({old: new})


def add_timestamp(name: str, column: str = "event_ts") -> Transform:
    return lambda df: _after(lambda image: _with_field(image, name, F.col(column)))(df)


def mark_write_mode(until: Column, mode: str = "upsert") -> Transform:
    """Marks the events of a catch-up window, those before ``until``."""
    return lambda df: df.withColumn("metadata", F.when(F.col("event_ts") < until, _with_field(F.coalesce("metadata", F.create_map().cast("map<string,string>")), "_write_mode", F.lit(mode))).otherwise(F.col("metadata")))


def custom(kind: str = "native", function: Transform | None = None) -> Transform:
    """A native function, or nothing; script kinds are not built."""
    if kind in ("lua", "wasm"):
        raise NotImplementedError(f"{kind} transforms")
    if kind != "native":
        raise ValueError(f"unknown transform kind {kind!r}")
    return function or identity


class TransformRegistry:
    """Named transforms."""

    def __init__(self):
        self._by_name: dict[str, Transform] = {}

    def register(self, name: str, transform: Transform) -> None:
        if not name:
            raise ValueError("a transform needs a name")
        self._by_name[name] = transform

    def get(self, name: str) -> Transform:
        if name not in self._by_name:
            raise KeyError(name)
        return self._by_name[name]

    def remove(self, name: str) -> None:
        self._by_name.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self._by_name)
