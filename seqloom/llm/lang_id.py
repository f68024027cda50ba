"""Language identification by string kernels.

A text is the set of its letter n-grams of lengths 1 to 3 (letters in lower case in 63 classes, all else a gap): the blended
spectrum with presence instead of counts. The kernel of two texts is the number of n-grams they share over the root
of the product of their numbers. Kernel ridge regression, one language against the rest, runs on Nyström features of at
most LANDMARKS landmark texts, dealt evenly to the languages. A batch of texts is scored by two matrix products: presence by
landmarks' presence, which gives kernel values, and kernel values by weights.

Only n-grams that landmarks have are columns of the first product; the others count in the kernel's denominator alone.

Null texts, and texts without a letter, are `und` with score 0. Repeated rows are predicted one by one. With fewer than two
languages to learn from, the only one (or `und`) is predicted for all texts that have a letter.

Learning uses about SAMPLE_ROWS rows, as many of each language and LEAST_ROWS at least, chosen by a hash of id and text, each reduced to its
set of n-grams; equal sets of one language count once. At most MAX_LANGUAGES languages are learned, the most frequent; others are warned of.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import bounded_batches, crc_of_id, free_name, table, without

SAMPLE_ROWS = 3_000
LEAST_ROWS = 50
MAX_LANGUAGES = 1_000
LANDMARKS = 256
#: Texts scored by one matrix product.
TOGETHER = 256
RIDGE = 1e-2
UNKNOWN = "und"
_SIZES = (64, 64**2, 64**3)
SPACE = sum(_SIZES)


@lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """Class of each code point: 0 for what isn't a letter, 1 to 26 for a to z, 27 to 63 for other letters."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = ord(s.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % 37
    return out


def ngrams(text: str) -> np.ndarray:
    """Numbers of the text's different n-grams, ascending; none if it has no letter. A buffer of SPACE flags is all it holds beside the text."""
    classes = letter_classes()
    seen = np.zeros(SPACE, bool)
    last = np.zeros(0, np.int32)
    step = 1 << 20
    for a in range(0, len(text), step):
        c = classes[np.frombuffer(text[a : a + step].encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int32)
        seen[c] = True
        c = np.concatenate((last, c))
        pairs = c[:-1] * 64 + c[1:]
        seen[_SIZES[0] + pairs] = True
        seen[_SIZES[0] + _SIZES[1] + pairs[:-1] * 64 + c[2:]] = True
        last = c[-2:]
    seen[0] = False
    if not seen[1:64].any():
        return np.zeros(0, np.int32)
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # of each n-gram, or -1
    landmarks: np.ndarray  # n-grams by landmarks: presence over the root of the landmark's number of n-grams
    weights: np.ndarray  # landmarks by languages

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        sets = [ngrams(t) for t in texts]
        if len(self.languages) < 2:
            only = self.languages[0] if self.languages else UNKNOWN
            return [only if len(s) else UNKNOWN for s in sets], [float(len(s) > 0 and only != UNKNOWN) for s in sets]
        present = np.zeros((len(texts), self.landmarks.shape[0]), np.float32)
        for row, s in zip(present, sets, strict=True):
            cols = self.column[s]
            row[cols[cols >= 0]] = 1
        sizes = np.array([max(1, len(s)) for s in sets], np.float32)
        margins = (present @ self.landmarks / np.sqrt(sizes)[:, None]) @ self.weights
        best = margins.argmax(1)
        odds = np.exp(6 * (margins - margins.max(1, keepdims=True)))
        share = 1 / odds.sum(1)
        return [self.languages[b] if len(s) else UNKNOWN for b, s in zip(best, sets, strict=True)], [float(p) if len(s) else 0.0 for p, s in zip(share, sets, strict=True)]


def fit(sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    languages = sorted(set(langs))
    column = np.full(SPACE, -1, np.int32)
    if len(languages) < 2:
        return Model(languages, column, np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    each = max(1, landmarks // len(languages))
    at = [i for g in languages for i in [k for k, x in enumerate(langs) if x == g][:each]]
    used = np.unique(np.concatenate([sets[i] for i in at]))
    column[used] = np.arange(len(used))
    marks = np.zeros((len(used), len(at)), np.float32)
    for j, i in enumerate(at):
        marks[column[sets[i]], j] = 1 / np.sqrt(len(sets[i]))
    kernel = np.zeros((len(sets), len(at)), np.float32)
    for row, s in zip(kernel, sets, strict=True):
        cols = column[s]
        row[:] = marks[cols[cols >= 0]].sum(0) / np.sqrt(len(s))
    values, vectors = np.linalg.eigh(kernel[at].astype(np.float64))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    x = kernel @ root
    y = np.where(np.array(langs)[:, None] == np.array(languages), 1.0, -1.0)
    w = np.linalg.solve(x.T @ x + ridge * len(sets) / 100 * np.eye(x.shape[1]), x.T @ y)
    return Model(languages, column, marks, (root @ w).astype(np.float32))


def sample_of(rows: DataFrame, sample_rows: int) -> DataFrame:
    """(lang, text) of rows(id, lang, text): by a hash of id and text about as many of each language, half as many again as asked for."""
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        warnings.warn(f"only the {MAX_LANGUAGES} most frequent languages are learned", stacklevel=2)
        counts = counts[:MAX_LANGUAGES]
    each = max(LEAST_ROWS, sample_rows // max(1, len(counts)))
    shares = [(r["lang"], int(min(1.0, 1.5 * each / r["count"]) * 2**32)) for r in counts]
    shares = rows.sparkSession.createDataFrame(shares, "lang string, share long")
    picked = rows.join(F.broadcast(shares), "lang").where(F.shiftrightunsigned(F.xxhash64("id", "text"), 32) < F.col("share"))
    return picked.select("lang", "text")


def train(docs: DataFrame, learn_from: Column | None = None, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> Model:
    """Learn from text and language of the rows where learn_from holds and the language is not null."""
    bounded_batches(docs.sparkSession)
    lang, text = F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    rows = docs.where(lang.isNotNull() & text.isNotNull() & (F.lit(True) if learn_from is None else learn_from))
    own = F.col(f"`{id_col}`").cast("string") if id_col in docs.columns else F.lit(None).cast("string")
    rows = sample_of(rows.select(own.alias("id"), lang.cast("string").alias("lang"), text.alias("text")), sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [ngrams(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["lang", "grams"])

    # sets of at most SPACE numbers, about as many as rows asked for; those of equal texts and language are one
    found = sorted((crc32(r["grams"]), r["lang"], bytes(r["grams"])) for r in rows.mapInArrow(run, "lang string, grams binary").where("length(grams) > 0").distinct().collect())
    return fit([np.frombuffer(g, np.int32) for _, _, g in found], [lang for _, lang, _ in found])


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score, in place of columns of these names."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = [], []
            for a in range(0, b.num_rows, TOGETHER):
                more = shared.value.predict([t or "" for t in b.column(b.num_columns - 1).slice(a, TOGETHER).to_pylist()])
                lang += more[0]
                score += more[1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    kept = without(df, "lang_pred", "score")
    return df.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(f"`{text_col}`").alias(free_name(kept.columns, "text_to_score"))).mapInArrow(run, StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(crc_of_id(), F.lit(4)) == 2
    model = train(docs, ~held_out)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
