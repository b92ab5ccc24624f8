"""Event filters as columns: chains, rules, capture scopes and expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions.keys import ABSENT, table_name
from ..functions.text import wildcard



def pass_all() -> Column:
    return F.lit(True)


def block_all() -> Column:
    return F.lit(False)


def chain(filters: Iterable[Column]) -> Column:
    """All of the filters; an empty chain passes."""
    return reduce(lambda a, b: a & b, filters, F.lit(True))


def _matches(patterns: Iterable[str], text: Column) -> Column:
    """Any pattern is found in the text; the patterns are checked on the driver."""
    patterns = list(patterns)
    for p in patterns:
        portable_regex(p)
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns], F.lit(False))


def portable_regex(pattern: str) -> str:
    """Rejects what a linear-time engine would: look-around and back-references."""
    if re.search(r"\(\?<?[=!]|\\[1-9]|\(\?P=", pattern):
        raise ValueError(f"pattern {pattern!r} uses look-around or a back-reference")
    re.compile(re.sub(r"\\[pPzQEA]", "x", pattern))
    return pattern


@dataclass(frozen=True)
class RuleFilter:
    """Excludes and includes by event type, database and ``db.table``.

    The order is fixed: exclude types, include types, exclude databases, include
    databases, exclude tables, include tables.  An empty include list is no
    constraint.  Patterns are searched for, not anchored.
    """

    include_types: tuple[str, ...] = ()
    exclude_types: tuple[str, ...] = ()
    include_databases: tuple[str, ...] = ()
    exclude_databases: tuple[str, ...] = ()
    include_tables: tuple[str, ...] = ()
    exclude_tables: tuple[str, ...] = ()

    def column(self, op: Column, database: Column, table: Column) -> Column:
        name = table_name(database, table)
        parts = []
        if self.exclude_types:
            parts.append(~op.isin(*self.exclude_types))
        if self.include_types:
            parts.append(op.isin(*self.include_types))
        for text, exclude, include in ((database, self.exclude_databases, self.include_databases), (name, self.exclude_tables, self.include_tables)):
            if exclude:
                parts.append(~_matches(exclude, text))
            if include:
                parts.append(_matches(include, text))
        return chain(parts)


@dataclass(frozen=True)
class DatabaseScope:
    """Captured databases (or exactly ``*``), less ignored, of filtered tables."""

    databases: tuple[str, ...] = ("*",)
    filter_regex: tuple[str, ...] = ()
    ignore_regex: tuple[str, ...] = ()
    sync_ddl: bool = True

    def column(self, database: Column, table: Column) -> Column:
        name = table_name(database, table)
        captured = F.lit(True) if self.databases == ("*",) else database.isin(*self.databases)
        try:
            ignored, wanted = _matches(self.ignore_regex, name), _matches(self.filter_regex, name) if self.filter_regex else F.lit(True)
        except (re.error, ValueError):
            return F.lit(False)
        return captured & ~ignored & wanted


@dataclass(frozen=True)
class TableScope:
    """Exactly the listed ``db.table`` names."""

    tables: tuple[str, ...]
    sync_ddl: bool = True

    def column(self, database: Column, table: Column) -> Column:
        return table_name(database, table).isin(*self.tables)


def parse_scope(tables: Iterable[str]) -> list[tuple[str, str]]:
    """(database, table) pairs; a name is cut at its first dot."""
    out = []
    for name in tables:
        database, dot, table = name.partition(".")
        if not dot or not database or not table:
            raise ValueError(f"table {name!r} is not db.table")
        out.append((database, table))
    return out


def capture(databases: Iterable[str], tables: dict[str, Iterable[str]], database: Column, table: Column) -> Column:
    """The older scope: no databases is all; a listed one passes whole; else
    wildcard patterns of tables per database."""
    databases = list(databases)
    if not databases and not tables:
        return F.lit(True)
    out = database.isin(*databases) if databases else F.lit(False)
    for name, patterns in tables.items():
        out = out | ((database == name) & reduce(lambda a, b: a | b, [wildcard(p, table) for p in patterns], F.lit(False)))
    return out


def schema_covers(own: Column, other: Column) -> Column:
    """Every ``name:type`` of ``own`` is in ``other``."""
    return F.size(F.array_except(own, other)) == 0


# -- expression language -------------------------------------------------------

#: Operators in the order in which a leaf is searched for them.
OPERATORS = ("==", "!=", ">=", "<=", ">", "<", "=~", "!~")
FIELDS = {"table": "table", "database": "database", "schema": "schema", "operation": "op", "op": "op"}


@dataclass(frozen=True)
class Expression:
    """A filter expression compiled to a column.

    ``field op literal`` leaves are joined by ``||``, which binds tighter than
    ``&&``; there are neither parentheses nor negation.  Equality is null-safe
    and typed by the literal.  Ordering wants numbers: with ``strict`` other
    values raise, else they fail the test.  Patterns see null as ``<nil>``.
    Integer widths are not told apart.
    """

    text: str
    columns: dict[str, Column] = field(default_factory=dict)
    before: Callable[[str], Column] | None = None
    after: Callable[[str], Column] | None = None
    strict: bool = False

    def column(self) -> Column:
        if not self.text.strip():
            return F.lit(True)
        groups = [[self._leaf(leaf) for leaf in part.split("||")] for part in self.text.split("&&")]
        return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, g) for g in groups])

    def _leaf(self, leaf: str) -> Column:
        operator = next((o for o in OPERATORS if o in leaf), None)
        if operator is None:
            raise ValueError(f"no operator in {leaf!r}")
        left, right = (x.strip() for x in leaf.split(operator, 1))
        value, literal = self._field(left), self._literal(right)
        if operator in ("=~", "!~"):
            found = F.coalesce(value.cast("string"), F.lit(ABSENT)).rlike(portable_regex(str(literal)))
            return found if operator == "=~" else ~found
        if operator in ("==", "!="):
            same = self._equal(value, literal)
            return same if operator == "==" else ~same
        number = value.try_cast("double")
        if isinstance(literal, bool) or not isinstance(literal, int | float):
            return F.raise_error(f"{right} is no number").cast("boolean") if self.strict else F.lit(False)
        test = {">": number > literal, "<": number < literal, ">=": number >= literal, "<=": number <= literal}[operator]
        otherwise = F.raise_error(F.concat(F.lit(f"{left} is no number: "), F.coalesce(value.cast("string"), F.lit(ABSENT)))).cast("boolean") if self.strict else F.lit(False)
        return F.when(number.isNotNull(), test).otherwise(otherwise)

    @staticmethod
    def _equal(value: Column, literal) -> Column:
        if literal is None:
            return value.isNull()
        if isinstance(literal, bool):
            return F.coalesce(value.try_cast("boolean") == literal, F.lit(False))
        if isinstance(literal, int | float):
            return F.coalesce(value.try_cast("double") == float(literal), F.lit(False))
        return value.cast("string").eqNullSafe(F.lit(literal))

    def _field(self, name: str) -> Column:
        if name in FIELDS:
            return self.columns[FIELDS[name]]
        side, dot, inner = name.partition(".")
        if dot and side in ("before", "after"):
            image = self.before if side == "before" else self.after
            if image is None:
                raise ValueError(f"no {side} image")
            return image(inner)
        found = [image(name) for image in (self.after, self.before) if image is not None]
        if not found:
            raise ValueError(f"unknown field {name!r}")
        return F.coalesce(*found)

    @staticmethod
    def _literal(text: str):
        if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
            return text[1:-1]
        if text in ("true", "false"):
            return text == "true"
        if text in ("null", "nil"):
            return None
        try:
            return float(text) if "." in text else int(text)
        except ValueError:
            return text
