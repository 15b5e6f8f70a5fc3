"""Mutation expressions: parsing to a plan, once, on the driver.

A plan is an ordered list of steps. The language, by example:

``/name="x"``           set a literal (quotes make numbers settable)
``/n=2``                add 2: a bare number is an increment
``/n++`` ``/n--``       add or take one
``rm:/a/b``             remove (also ``remove:``, ``delete:``, ``del:``)
``time:/t=NOW``         set a time, in UTC with nanoseconds
``textfile:/p=f``       set the text of a file (UTF-8 without NUL)
``base64file:/p=f``     set a file in base64
``file:/p=f``           text where it is clean, else base64
``/a{/b=1,/c++}``       the same prefix for several expressions
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from larkspur.functions import pointers, times


class MutationError(ValueError):
    """An expression that cannot be parsed, or a step that cannot be applied."""


@dataclass(frozen=True)
class Step:
    """``kind`` is set, increment or remove."""

    kind: str
    path: tuple[str, ...]
    value: Any = None


#: Fixed values of the language.
FILE_PREFIXES = ("file:", "textfile:", "base64file:")
REMOVE_PREFIXES = ("rm:", "remove:", "delete:", "del:")
TIME_PREFIX = "time:"
_NUMBER = re.compile(r"\s*[+-]?(?:0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)(?:[pP][+-]?\d+)?|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|inf(?:inity)?|nan(?:\(\w*\))?)\Z", re.IGNORECASE | re.ASCII)
_INT64 = re.compile(r"[+-]?\d+\Z", re.ASCII)


def as_number(text: str) -> float | None:
    """The value of a text that is a C floating-point literal as a whole; else None."""
    if not _NUMBER.match(text):
        return None
    text = text.strip().lower()
    if "0x" in text:
        return float.fromhex(text)
    return math.nan if "nan" in text else float(text)


def literal(text: str) -> Any:
    """A trimmed value without its quotes: true, false, null, a whole number, a number, or text."""
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        text = text[1:-1]
    known = {"true": True, "false": False, "null": None}
    if text.lower() in known:
        return known[text.lower()]
    if _INT64.match(text) and -(1 << 63) <= int(text) < 1 << 63:
        return int(text)
    number = as_number(text)
    return text if number is None else number


class Parser:
    """Parses expressions with one clock value and one way to read files."""

    def __init__(self, now: tuple[int, int] | None = None, read_file: Callable[[str], bytes] | None = None, base_dir: str | None = None) -> None:
        self.now, self.base_dir = now, base_dir
        self.read_file = read_file or self._from_base_dir

    def plan(self, expressions: list[str]) -> list[Step]:
        steps = [s for e in expressions if e.strip() for s in self._expression(e.strip())]
        if not steps:
            raise MutationError("no mutations")
        return steps

    def _expression(self, text: str) -> list[Step]:
        file_kind = next((p for p in FILE_PREFIXES if text.startswith(p)), "")
        rest = text[len(file_kind) :]
        removal = "" if file_kind else next((p for p in REMOVE_PREFIXES if rest.startswith(p)), "")
        rest = rest[len(removal) :]
        timed = rest.startswith(TIME_PREFIX)
        if timed and (file_kind or removal):
            raise MutationError("time: cannot be combined with a file or a removal")
        rest = rest[len(TIME_PREFIX) :] if timed else rest
        if removal:
            return [Step("remove", self._path(rest))]
        for suffix, delta in (("++", 1.0), ("--", -1.0)):
            if rest.endswith(suffix):
                return [Step("increment", self._path(rest[:-2]), delta)]
        if rest.endswith("}") and rest.find("{") > 0:
            at = rest.index("{")
            # the prefix alone goes on: file and time do not reach into braces
            return [s for part in split_parts(rest[at + 1 : -1]) for s in self._expression((rest[:at] + part).strip())]
        path, equals, value = rest.partition("=")
        if not equals:
            raise MutationError("invalid mutation expression")
        if file_kind:
            return [Step("set", self._path(path), self._file(file_kind, value))]
        if timed:
            return [Step("set", self._path(path), self._time(value))]
        number = as_number(value)
        if number is not None:
            if number == 0:
                raise MutationError("increment mutation requires non-zero delta")
            return [Step("increment", self._path(path), number)]
        return [Step("set", self._path(path), literal(value))]

    @staticmethod
    def _path(text: str) -> tuple[str, ...]:
        try:
            return tuple(pointers.parse(text.strip()))
        except pointers.PointerError as e:
            raise MutationError(str(e)) from e

    def _time(self, value: str) -> str:
        value = literal(value)
        if value in ("NOW", "now"):
            if self.now is None:
                raise MutationError("no clock was given for NOW")
            return times.utc(*self.now)
        try:
            return times.utc(*times.parse(str(value)))
        except ValueError as e:
            raise MutationError(str(e)) from e

    def _file(self, kind: str, name: str) -> str:
        name = name.strip()
        if len(name) >= 2 and name[0] == name[-1] and name[0] in "\"'":
            name = name[1:-1]
        data = self.read_file(name)
        if kind == "base64file:":
            return base64.b64encode(data).decode()
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = "\0"
        if "\0" not in text:
            return text
        if kind == "textfile:":
            raise MutationError("invalid UTF-8 in textfile mutation")
        return base64.b64encode(data).decode()

    def _from_base_dir(self, name: str) -> bytes:
        if self.base_dir is None:
            raise MutationError("files need a base folder")
        root = os.path.realpath(self.base_dir)
        path = os.path.realpath(os.path.join(root, os.path.expanduser(name)))
        if os.path.commonpath([root, path]) != root:
            raise MutationError("a file must lie below the base folder")
        with open(path, "rb") as file:
            return file.read()


def split_parts(body: str) -> list[str]:
    """The parts between commas or line ends that stand outside quotes and inner braces; what is not closed reaches to the end."""
    parts, part, quote, depth, skip = [], "", "", 0, False
    for c in body:
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "{}":
            depth += 1 if c == "{" else -1
        elif c in ",\n" and depth == 0:
            parts.append(part)
            part = ""
            continue
        part += c
    return [p.strip() for p in [*parts, part] if p.strip()]
