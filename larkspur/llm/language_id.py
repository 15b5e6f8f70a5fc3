"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else counts as a blank, and all n-grams of
one to three characters that hold a letter are hashed into ``BUCKETS``
features. Learning adds up feature counts for each language over all labelled
rows (one pass; each task emits fixed-size blocks of counts). The resulting
matrix of log-probabilities (languages x BUCKETS, independent of the number of
documents) is broadcast, and batches are scored in numpy.

Defined cases: a text that is null or has no letter is ``und`` with score 0,
and so is every text where nothing was learned; ties go to the language that
sorts first; long texts are read whole, in stretches; more than ``LANGUAGES``
labels are refused (each takes 256 KB of the broadcast matrix); repeated rows are predicted alike;
an empty table gives no rows; only the named columns are read and the working
ones carry the prefix ``_li_``, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import count_blocks
from larkspur.llm.pretokens import LETTER, classes, code_points
from larkspur.llm.text_arrays import mix, slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Code points of a group of texts whose n-grams are hashed at once; longer texts are cut.
STRETCH = 1 << 16
#: Languages that learning takes at most: the matrix has 256 KB for each.
LANGUAGES = 200
#: Added to each feature count.
SMOOTHING = 0.1


def stretches(texts: list[str | None], limit: int = STRETCH) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Lower-cased texts between two blanks, in groups of about ``limit`` code points.

    A group has the numbers of its texts, stretches of them, and how many
    n-grams of each order may begin in each stretch. A long text is cut; a
    stretch then also has the two code points behind it.
    """
    rows, parts, begins, size = [], [], [], 0
    for row, text in enumerate(texts):
        padded = f"  {(text or '').lower()}  "
        for at in range(0, len(padded), limit):
            part = padded[at : at + limit + 2]
            rows.append(row)
            parts.append(part)
            begins.append(min(limit, len(part)))
            size += len(part)
            if size >= limit:
                yield rows, parts, begins
                rows, parts, begins, size = [], [], [], 0
    if rows:
        yield rows, parts, begins


def features(parts: list[str], begins: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all stretches, one after another, and how many each has."""
    points = code_points("".join(parts))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends, letter = np.cumsum(sizes), classes()[points] == LETTER
    points = np.where(letter, points, 0x20).astype(np.uint64)
    room = np.arange(len(points)) < np.repeat(ends - sizes + np.array(begins, np.int64), sizes)
    hashed, counts = [], []
    for n in ORDERS:
        value, used = points.copy(), letter.copy()
        for k in range(1, n):
            value[:-k] = value[:-k] * np.uint64(0x9E3779B1) + points[k:]
            used[:-k] |= letter[k:]
        used &= room
        for k in range(1, n):  # too near the end of its stretch for n code points
            used[ends[sizes >= k] - k] = False
        at = np.flatnonzero(used)
        hashed.append((mix(value[at] * np.uint64(4) + np.uint64(n)) >> np.uint64(48)).astype(np.int32))
        counts.append(np.diff(np.searchsorted(at, ends), prepend=0))
    # stretch by stretch: the n-grams of each order of a stretch stand together
    order = np.argsort(np.concatenate([np.repeat(np.arange(len(parts)), c) for c in counts]), kind="stable")
    return np.concatenate(hashed)[order], sum(counts)


@dataclass(frozen=True)
class Model:
    """Languages, and log-probabilities (features x languages) with log priors."""

    languages: tuple[str, ...]
    log_probability: np.ndarray
    log_prior: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The predicted language and its posterior probability for each text."""
        total, found = np.tile(self.log_prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        for rows, parts, begins in stretches(texts):
            hashed, counts = features(parts, begins)
            some = np.flatnonzero(counts)
            if len(some):
                at = (np.cumsum(counts) - counts)[some]
                np.add.at(total, np.array(rows)[some], np.add.reduceat(self.log_probability[hashed], at, axis=0, dtype=np.float64))
                np.add.at(found, rows, counts)
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), found.tolist(), strict=True)], np.where(found > 0, share, 0.0)


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = SMOOTHING) -> Model:
    """Fit on every row whose language is not null."""
    source = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("_li_text"), F.col(lang_col).cast("string").alias("_li_lang"))
    if source.select("_li_lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: the column does not hold language tags")
    width = BUCKETS + 1  # the last place counts documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        names: dict[str, int] = {}
        for batch in batches:
            for begin, end in slices(batch.column(0)):
                texts = batch.column(0).slice(begin, end - begin).to_pylist()
                langs = batch.column(1).slice(begin, end - begin).to_pylist()
                for lang in set(langs) - set(counts):
                    counts[lang], names[lang] = np.zeros(width, np.int64), len(names)
                for rows, parts, begins in stretches(texts):
                    hashed, sizes = features(parts, begins)
                    own = [langs[r] for r in rows]
                    of = np.repeat([names[x] for x in own], sizes)
                    for lang in set(own):
                        counts[lang][:BUCKETS] += np.bincount(hashed[of == names[lang]], minlength=BUCKETS)
                for lang in langs:
                    counts[lang][BUCKETS] += 1
        yield from count_blocks.emit(counts)

    found = count_blocks.to_arrays(count_blocks.total(source.mapInArrow(run, count_blocks.SCHEMA)), width)
    languages = tuple(sorted(found))
    counts = np.array([found[x] for x in languages], np.float64).reshape(len(languages), width)
    seen, documents = counts[:, :BUCKETS] + smoothing, counts[:, BUCKETS]
    log_probability = np.log(seen / seen.sum(axis=1, keepdims=True)).T.astype(np.float32).copy() if languages else np.zeros((BUCKETS, 0), np.float32)
    return Model(languages, log_probability, np.log(documents / max(documents.sum(), 1)) if languages else np.zeros(0))


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in (lang_out, score_out)]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs: list[str] = []
            scores = [np.zeros(0)]
            for begin, end in slices(batch.column(place)):
                made = shared.value.score(batch.column(place).slice(begin, end - begin).to_pylist())
                langs += made[0]
                scores.append(made[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=schema.names)

    return docs.select(*names).mapInArrow(run, schema)


def held_out(docs: DataFrame, id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> DataFrame:
    """``docs`` with ``held_out``: whether the id falls in the fold that learning must not see."""
    return docs.withColumn("held_out", count_blocks.bucket(id_col, folds) == fold)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn on the folds that are not held out, then predict every document: id, held_out, lang_pred, score."""
    split = held_out(docs.select(F.col(id_col), F.col(text_col), F.col(lang_col)), id_col)
    model = learn(split.where(~F.col("held_out")), text_col, lang_col)
    return predict(split.drop(lang_col), model, text_col).drop(text_col)


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is known with a posterior of ``least`` or more, as they were."""
    model = learn(held_out(docs).where(~F.col("held_out")))
    tagged = predict(docs, model, lang_out="_li_pred", score_out="_li_score")
    return tagged.where((F.col("_li_pred") != UNKNOWN) & (F.col("_li_score") >= least)).select(docs.columns)
