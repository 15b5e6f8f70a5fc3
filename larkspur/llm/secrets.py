"""Secret scans with multipart credential linking.

A scan of each text finds spans of these kinds (code points, end exclusive):

* strong, always reported: ``assign`` (a named password, token, key ...),
  ``access`` (access key ids) and ``hex`` (long hexadecimal strings);
* weak, reported only when a complementary part stands near by: ``account``
  (a named user or client), ``random`` (40 characters that mix cases and
  digits) and ``endpoint`` (a service address).

Parts have roles: *identifier* (access, account), *secret* (assign, hex,
random), *endpoint*. A weak part is kept when, in its scope (a stretch of text
between blank lines), there is a part of another role with at most ``REACH``
code points between the end of one and the begin of the other. That is an
interval join, and only its existence is asked for: a part is put into every
bucket of ``REACH`` code points that it covers; for each document, scope and
bucket the first begin and last end of each role are kept, and every weak part
looks at its own buckets and the two beside them. So a scope with many parts
costs the buckets of its parts, never its pairs.

Defined cases: null counts as empty; long texts are scanned whole; a document
is its id and text, so repeated rows get the same spans, and rows that share
an id but not their text are told apart; a null id is an id of its own; an
empty table gives no rows; working columns carry the prefix ``_se_``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.text_arrays import slices
from larkspur.shared import materialize

#: The kinds in the order of the report.
KINDS = ("assign", "access", "hex", "account", "random", "endpoint")
STRONG = ("assign", "access", "hex")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "random": "secret", "endpoint": "endpoint"}
#: Code points between parts that belong together, at most.
REACH = 400

_FLAGS = re.ASCII | re.IGNORECASE
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ACCOUNT = re.compile(r"""(?:user(?:name)?|client_id|account_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", _FLAGS)
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", re.ASCII)
_ENDPOINT = re.compile(r"""(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>]+""", _FLAGS)
_BLANK = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The strong spans of a text, by begin and then kind."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def weak_spans(text: str) -> list[Span]:
    """Candidates that count only beside a complementary part; those inside a strong span are left out."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [("account", *m.span()) for m in _ACCOUNT.finditer(text)]
    if "://" in text:
        found += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    return found + [("random", *m.span()) for m in _RANDOM.finditer(text)]


def scan(text: str) -> list[dict]:
    """All spans of a text with the number of their scope."""
    strong = base_spans(text)
    begins, reached = [a for _, a, _ in strong], list(accumulate((b for _, _, b in strong), max))
    inside = lambda w: (i := bisect_right(begins, w[1])) > 0 and reached[i - 1] >= w[2]
    weak = [w for w in weak_spans(text) if not inside(w)]
    if not strong and not weak:
        return []
    scope, cuts, out = 0, [m.start() for m in _BLANK.finditer(text)] if weak else [], []
    for kind, start, end in sorted(strong + weak, key=lambda s: (s[1], KINDS.index(s[0]))):
        while scope < len(cuts) and cuts[scope] < start:
            scope += 1
        out.append({"kind": kind, "start": start, "end": end, "scope": scope})
    return out


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("scope", T.IntegerType())])
)
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("scope", pa.int32())]))


def _key(id_value: Column, text: Column) -> Column:
    """A document: its id and its text; the length of the id keeps them apart."""
    name = F.coalesce(F.concat(F.lit("="), id_value.cast("string")), F.lit("null"))
    return F.sha2(F.concat(F.char_length(name).cast("string"), name, F.coalesce(text, F.lit(""))), 256)


def linked(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak spans that have a complementary part within reach.

    ``spans``: ``_se_key, scope, kind, start, end``. The same columns return.
    """
    roles = sorted(set(ROLE.values()))
    role = F.create_map(*(F.lit(x) for pair in ROLE.items() for x in pair))[F.col("kind")]
    covered = F.sequence(F.floor(F.col("start") / reach), F.floor((F.col("end") - 1) / reach))
    parts = spans.withColumn("_se_role", role).withColumn("_se_bucket", F.explode(covered))
    ends = parts.groupBy("_se_key", "scope", "_se_bucket", "_se_role").agg(F.min("start").alias("_se_first"), F.max("end").alias("_se_last"))
    around = ends.withColumn("_se_side", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_se_bucket", F.col("_se_bucket") + F.col("_se_side"))
    seen = []
    for r in roles:
        own = F.col("_se_role") == r
        seen += [
            F.max(F.when(own & (F.col("_se_side") == 1), F.col("_se_last"))).alias(f"_se_{r}_before"),
            F.max(F.when(own & (F.col("_se_side") == 0), F.lit(True))).alias(f"_se_{r}_here"),
            F.min(F.when(own & (F.col("_se_side") == -1), F.col("_se_first"))).alias(f"_se_{r}_after"),
        ]
    near = around.groupBy("_se_key", "scope", "_se_bucket").agg(*seen)
    weak = parts.where(~F.col("kind").isin(*STRONG))
    holds = F.lit(False)
    for r in roles:
        there = (
            F.coalesce(F.col(f"_se_{r}_here"), F.lit(False))
            | F.coalesce(F.col("start") - F.col(f"_se_{r}_before") <= reach, F.lit(False))
            | F.coalesce(F.col(f"_se_{r}_after") - F.col("end") <= reach, F.lit(False))
        )
        holds = holds | ((F.col("_se_role") != r) & there)
    return weak.join(near, ["_se_key", "scope", "_se_bucket"]).where(holds).select("_se_key", "scope", "kind", "start", "end").distinct()


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row for each document row: ``id_col, _se_key, spans`` (kind, start, end), ordered.

    Texts are read once and not shuffled; what the scan found is written to the
    shared folder, so linking does not scan again.
    """
    source = docs.select(F.col(id_col).alias("_se_id"), _key(F.col(id_col), F.col(text_col)).alias("_se_key"), F.coalesce(text_col, F.lit("")).alias("_se_text"))
    schema = T.StructType([source.schema["_se_id"], source.schema["_se_key"], T.StructField("_se_all", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(2)):
                part = batch.slice(begin, end - begin)
                found = pa.array(map(scan, part.column(2).to_pylist()), _ARROW_SPANS)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], names=schema.names)

    found = materialize(source.mapInArrow(run, schema), "secret-spans")
    some_weak = F.exists("_se_all", lambda s: ~s["kind"].isin(*STRONG))
    parts = found.where(some_weak).dropDuplicates(["_se_key"]).select("_se_key", F.inline("_se_all"))
    kept = linked(parts, reach).groupBy("_se_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_se_weak"))
    strong = F.transform(
        F.filter("_se_all", lambda s: s["kind"].isin(*STRONG)),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    place = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    # ordered by begin, then by the order of the kinds
    keyed = F.transform(F.concat(strong, F.coalesce("_se_weak", empty)), lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["kind"].alias("kind"), s["end"].alias("end")))
    ordered = F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.join(kept, "_se_key", "left").select(F.col("_se_id").alias(id_col), "_se_key", ordered.alias("spans"))


def spans_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cut(texts: Iterator, spans: Iterator) -> Iterator[str | None]:
    for text, found in zip(texts, spans, strict=True):
        if not found or text is None:
            yield text
            continue
        out, at = [], 0
        for kind, start, end in sorted(((s["kind"], s["start"], s["end"]) for s in found), key=lambda s: s[1]):
            if start >= at:
                out += [text[at:start], f"[{kind}]"]
            at = max(at, end)
        yield "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; other texts stay as they are.

    ``n_chars``, where there is such a column, follows the new text.
    """
    found = find_spans(docs, id_col, text_col, reach).where(F.size("spans") > 0).select("_se_key", "spans").dropDuplicates(["_se_key"])
    tagged = docs.withColumn("_se_key", _key(F.col(id_col), F.col(text_col))).join(found.withColumnRenamed("spans", "_se_spans"), "_se_key", "left").drop("_se_key")
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(place)):
                columns = batch.slice(begin, end - begin).columns
                columns[place] = pa.array(_cut(columns[place].to_pylist(), columns[-1].to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays(columns[:-1], names=names)

    out = tagged.select(*docs.columns, "_se_spans").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
