"""Applying a mutation plan to a column of JSON documents.

The plan is compiled on the driver and shipped with the task; a document is
parsed once and all steps are applied to it, in order. Key order and the
spelling of untouched numbers are kept, which Spark's VARIANT would not do.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import pointers
from larkspur.plans.mutations import MutationError, Step


_LONE = re.compile("[\ud800-\udfff]")


class _Number(str):
    """A number as it was spelled."""


def _text(value: str) -> str:
    """A JSON string; surrogates without their other half stay escapes, as UTF-8 has no bytes for them."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False))


def _object(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    """An object whose names all differ; one of two equal names could not be addressed."""
    made = dict(pairs)
    if len(made) < len(pairs):
        raise MutationError("a name occurs twice in an object")
    return made


def _no_constant(name: str) -> Any:
    raise MutationError(f"invalid JSON: {name}")


def _write(value: Any) -> str:
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{_text(k)}:{_write(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_write, value)) + "]"
    if isinstance(value, float):
        return _spell(value)
    return _text(value) if isinstance(value, str) else json.dumps(value)


def _spell(x: float) -> str:
    if not math.isfinite(x):
        raise MutationError("a number must be finite")
    return str(int(x)) if x == int(x) and abs(x) < 1e17 else repr(x)


def _index(segment: str) -> int:
    return int(segment) if pointers.is_index(segment) else -1


def _parent(doc: Any, path: tuple[str, ...], create: bool) -> Any:
    """The container of the last segment; None where it is missing and may not be made."""
    at = doc
    for n, segment in enumerate(path[:-1]):
        if isinstance(at, dict):
            if segment not in at:
                if not create:
                    return None
                if pointers.is_index(path[n + 1]):
                    raise MutationError("missing array paths are not supported")
                at[segment] = {}
            at = at[segment]
        elif isinstance(at, list):
            i = _index(segment)
            if not 0 <= i < len(at):
                if create:
                    raise MutationError("missing array paths are not supported")
                return None
            at = at[i]
        elif create:
            raise MutationError("a path leads through a value that has no fields")
        else:
            return None
    return at


def _apply(doc: Any, step: Step) -> bool:
    """Apply one step in place; whether anything changed."""
    holder, last = _parent(doc, step.path, step.kind != "remove"), step.path[-1]
    if isinstance(holder, dict):
        place, there = last, last in holder
    elif isinstance(holder, list):
        place = _index(last)
        there = 0 <= place < len(holder)
        if not there and step.kind != "remove":
            raise MutationError("missing array paths are not supported")
    elif step.kind == "remove":
        return False
    else:
        raise MutationError("a path leads through a value that has no fields")
    if step.kind == "remove":
        if there:
            del holder[place]
        return there
    value = step.value
    if step.kind == "increment":
        if there:
            old = holder[place]
            if not isinstance(old, _Number):
                raise MutationError("increment target is not numeric")
            value = float(old) + value
        value = _Number(_spell(float(value)))
    elif isinstance(value, float):
        value = _Number(_spell(value))
    holder[place] = value
    return True


def mutate_text(doc: str | None, plan: list[Step]) -> str:
    """One document after all steps; a document without content begins as ``{}``."""
    text = doc if doc is not None and doc.strip() else "{}"
    try:
        tree = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant, object_pairs_hook=_object)
    except json.JSONDecodeError as e:
        raise MutationError(f"invalid JSON: {e.msg}") from e
    changed = [_apply(tree, step) for step in plan]
    return _write(tree) if any(changed) else text


def mutated(doc: Column, plan: list[Step], strict: bool = True) -> Column:
    """A struct of ``doc`` and ``error``. Strict plans end the job at the first error; else its row has a null doc."""

    @F.pandas_udf("doc string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for docs in batches:
            made: list[tuple[str | None, str | None]] = []
            for text in docs:
                try:
                    made.append((mutate_text(text, plan), None))
                except MutationError as e:
                    if strict:
                        raise
                    made.append((None, str(e)))
            yield pd.DataFrame(made, columns=["doc", "error"], dtype=object)

    return run(doc)


def mutate(docs: DataFrame, plan: list[Step], doc_col: str = "doc", strict: bool = True) -> DataFrame:
    """``docs`` with the document replaced; not strict: also ``mutation_error``."""
    made = docs.withColumn("_mutated", mutated(F.col(doc_col), plan, strict))
    out = made.withColumn(doc_col, F.col("_mutated.doc"))
    return (out if strict else out.withColumn("mutation_error", F.col("_mutated.error"))).drop("_mutated")
