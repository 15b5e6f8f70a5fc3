"""Document selectors, compiled to a boolean column.

``{"eq": {"field": "/kind", "value": "a"}}`` compares a field with a JSON
scalar; any other object is a shorthand whose top-level names must all equal
their values. Types are strict: the number 1 and the text "1" differ. ``and``,
``or``, ``not``, ``exists``, ``in``, ``prefix`` and ``range`` are extensions
of this library. Fields that a table keeps as typed columns of their own (an
*index*) are read from there, so Parquet can skip row groups by them: alone
where the column has every value that the condition can hold for, and before
the document where it has these and others. Else the document is read. A condition on a field that is missing is null, which a
filter takes as false; only ``not`` turns null to false first, so all other
conditions on index columns reach the scan.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import pointers


class SelectorError(ValueError):
    """A selector that is empty or has an operator that is not known."""


class Selector:
    """Compiles selectors against a document column and its index columns."""

    def __init__(self, doc: str = "doc", index: Mapping[str, tuple[str, str]] | None = None) -> None:
        self.doc, self.index = doc, dict(index or {})

    def compile(self, selector: str | dict) -> Column:
        tree = json.loads(selector) if isinstance(selector, str) and selector else selector
        if not isinstance(tree, dict) or not tree:
            raise SelectorError("a selector must be a JSON object that is not empty")
        return self._any(tree)

    def _any(self, tree: dict) -> Column:
        if len(tree) == 1:
            ((name, body),) = tree.items()
            made = getattr(self, f"_op_{name}", None)
            if made and isinstance(body, dict | list):
                return made(body)
        return self._all([self._equals("/" + k.replace("~", "~0").replace("/", "~1"), v) for k, v in tree.items()])

    @staticmethod
    def _all(parts: list[Column]) -> Column:
        return reduce(lambda a, b: a & b, parts)

    def _op_eq(self, body: dict) -> Column:
        return self._equals(body["field"], body["value"])

    def _op_and(self, body: list) -> Column:
        return self._all([self._any(b) for b in body])

    def _op_or(self, body: list) -> Column:
        return reduce(lambda a, b: a | b, [self._any(b) for b in body])

    def _op_not(self, body: dict) -> Column:
        return ~F.coalesce(self._any(body), F.lit(False))

    def _op_exists(self, body: dict) -> Column:
        return self._variant(body["field"]).isNotNull()

    def _op_in(self, body: dict) -> Column:
        return reduce(lambda a, b: a | b, [self._equals(body["field"], v) for v in body["values"]])

    def _op_prefix(self, body: dict) -> Column:
        return self._read(body["field"], "string").startswith(body["value"])

    def _op_range(self, body: dict) -> Column:
        value = self._read(body["field"], "double")
        tests = {"gt": lambda x: value > x, "gte": lambda x: value >= x, "lt": lambda x: value < x, "lte": lambda x: value <= x}
        found = [tests[k](F.lit(float(x)) if isinstance(x, float) else F.lit(x)) for k, x in body.items() if k in tests]
        if not found:
            raise SelectorError("a range needs a bound")
        return self._all(found)

    def _variant(self, field: str) -> Column:
        return F.try_variant_get(F.try_parse_json(F.col(self.doc)), pointers.spark_path(field), "variant")

    def _indexed(self, field: str, kind: str) -> Column | None:
        name, own = self.index.get(field, ("", ""))
        return F.col(name) if own == kind else None

    def _read(self, field: str, kind: str) -> Column:
        """A field's value where it is of a kind (a double is any number, a bigint a whole one); else null."""
        column = self._indexed(field, kind)
        return typed(self._variant(field), kind) if column is None else column

    def _equals(self, field: str, value: Any) -> Column:
        if value is None:
            return F.is_variant_null(self._variant(field))
        for known, kind in ((bool, "boolean"), (int, "bigint"), (float, "double"), (str, "string")):
            if isinstance(value, known):
                break
        else:
            raise SelectorError("only scalars can be compared")
        if kind == "bigint" and not -(1 << 63) <= value < 1 << 63:
            return F.lit(False)
        holds = self._read(field, kind) == F.lit(value).cast(kind)
        numbers = self._indexed(field, "double") if kind == "bigint" else None
        # a column of all numbers skips row groups; the document tells 1 from 1.0
        return holds if numbers is None else (numbers == F.lit(float(value))) & holds


#: Families of a variant's type name.
_FAMILIES = {"bigint": "^BIGINT$", "double": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "string": "^STRING$", "boolean": "^BOOLEAN$"}


def typed(variant: Column, kind: str) -> Column:
    """A variant's value where its own type is of the kind; else null."""
    return F.when(F.schema_of_variant(variant).rlike(_FAMILIES[kind]), F.try_variant_get(variant, "$", kind))
