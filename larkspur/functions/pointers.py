"""JSON pointers: parsing, and the path that Spark's JSON functions read."""

from __future__ import annotations

#: Segments that only a wildcard-capable evaluator understands.
WILDCARDS = frozenset({"*", "[]", "**", "..."})


class PointerError(ValueError):
    """A path that cannot address a field."""


def parse(pointer: str) -> list[str]:
    """Segments of a pointer. ``~1`` is a slash and ``~0`` a tilde; other tildes stand for themselves."""
    if not pointer.startswith("/"):
        raise PointerError("a path must start with '/'")
    segments = [s.replace("~1", "/").replace("~0", "~") for s in pointer[1:].split("/")]
    if "" in segments:
        raise PointerError("mutation path refers to document root")
    found = WILDCARDS.intersection(segments)
    if found:
        raise PointerError(f"wildcards are not supported in paths: {sorted(found)[0]}")
    return segments


def is_index(segment: str) -> bool:
    """Whether a segment may be the place of an array's item: ASCII digits alone."""
    return segment.isascii() and segment.isdigit()


def spark_path(pointer: str) -> str:
    """The same address for ``get_json_object`` and ``variant_get``, every name in brackets."""
    out = "$"
    for s in parse(pointer):
        if "'" in s:
            raise PointerError("a quote in a path cannot be read by Spark")
        out += f"[{s}]" if is_index(s) else f"['{s}']"
    return out
