"""Filters: a small OData language compiled to Columns, globs, and SQL conditions.

Comparisons are two-valued: a null equals only null, differs from everything else, and is in no
order with anything, so ``not`` of an ordered comparison with null is true.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import glob_pattern

TOKEN = re.compile(r"\s*(?:('(?:[^']|'')*')|([(),:])|([^\s(),:']+(?::[^\s(),:']+)*))")
COMPARISONS = {"eq", "ne", "gt", "ge", "lt", "le"}


class Parser:
    """Recursive descent: or, and, not, then a comparison, search.in, any, or brackets."""

    def __init__(self, text: str, schema: T.StructType):
        self.schema = {f.name.lower(): f for f in schema.fields}
        self.tokens, at = [], 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"bad token at {text[at : at + 20]!r}")
            self.tokens.append(m.group(0).strip())
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        token = self.peek()
        if not token or (want is not None and token.lower() != want):
            raise ValueError(f"expected {want or 'more'}, found {token!r}")
        self.at += 1
        return token

    def parse(self) -> Column:
        out = self.either()
        if self.peek():
            raise ValueError(f"unexpected {self.peek()!r}")
        return out

    def either(self) -> Column:
        out = self.both()
        while self.peek().lower() == "or":
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self.peek().lower() == "and":
            self.take()
            out = out & self.one()
        return out

    def one(self) -> Column:
        token = self.peek()
        if token.lower() == "not":
            self.take()
            return ~self.one()
        if token == "(":
            self.take()
            out = self.either()
            self.take(")")
            return out
        if token.lower() == "search.in":
            return self.search_in()
        if token.lower().endswith("/any"):
            return self.any()
        name = self.take()
        return self.compare(self.field(name), self.kind(name), self.take().lower(), self.take())

    def field(self, name: str) -> Column:
        if name.lower() not in self.schema:
            raise ValueError(f"no field {name!r}")
        return F.col(f"`{self.schema[name.lower()].name}`")

    def kind(self, name: str) -> T.DataType:
        return self.schema[name.lower()].dataType

    @staticmethod
    def literal(token: str):
        if token.startswith("'"):
            return token[1:-1].replace("''", "'")
        if token.lower() in ("true", "false"):
            return token.lower() == "true"
        if token.lower() == "null":
            return None
        try:
            return float(token)
        except ValueError:
            return token

    def compare(self, left: Column, kind: T.DataType, op: str, token: str) -> Column:
        if op not in COMPARISONS:
            raise ValueError(f"unknown comparison {op!r}")
        value = self.literal(token)
        if value is None:
            return {"eq": left.isNull(), "ne": left.isNotNull()}.get(op, F.lit(False))
        if isinstance(value, bool):
            left, right = (left if isinstance(kind, T.BooleanType) else left.cast("string")), F.lit(value if isinstance(kind, T.BooleanType) else str(value).lower())
        elif isinstance(kind, (T.TimestampType, T.DateType)):
            right = F.lit(str(value)).try_cast(kind.simpleString())
        elif isinstance(value, float):
            left, right = (left if isinstance(kind, T.NumericType) else left.try_cast("double")), F.lit(value)
        else:
            left, right = left.cast("string"), F.lit(value)
        if op in ("eq", "ne"):
            same = left.eqNullSafe(right)
            return same if op == "eq" else ~same
        ordered = {"gt": left > right, "ge": left >= right, "lt": left < right, "le": left <= right}[op]
        return F.coalesce(ordered, F.lit(False))

    def search_in(self) -> Column:
        self.take()
        self.take("(")
        field = self.field(self.take())
        self.take(",")
        names, separator = self.literal(self.take()), ","
        if self.peek() == ",":
            self.take()
            separator = self.literal(self.take())
        self.take(")")
        members = [m.strip() for m in names.split(separator)]
        return F.coalesce(field.cast("string").isin(members), F.lit(False))

    def any(self) -> Column:
        name = self.take()[: -len("/any")]
        kind = self.kind(name)
        if not isinstance(kind, T.ArrayType):
            raise ValueError(f"{name} is not a collection")
        self.take("(")
        variable = self.take()
        self.take(":")
        if self.take() != variable:
            raise ValueError("any() must compare its own variable")
        op, token = self.take().lower(), self.take()
        self.take(")")
        return F.coalesce(F.exists(self.field(name), lambda x: self.compare(x, kind.elementType, op, token)), F.lit(False))


def odata(df: DataFrame, text: str) -> Column:
    """The filter as a Column of df; ValueError if it does not parse."""
    return Parser(text, df.schema).parse()


def documents_in(column: Column, names: list[str]) -> Column:
    return column.isin(names) if names else F.lit(False)


def matches_any(column: Column, globs: list[str]) -> Column:
    """Case-insensitive globs."""
    return reduce(lambda a, b: a | b, (F.lower(column).rlike(glob_pattern(g)) for g in globs), F.lit(False))


def where(df: DataFrame, condition: str) -> DataFrame:
    """A SQL condition; anything after a complete condition is an error."""
    return df.where(F.expr(condition))
