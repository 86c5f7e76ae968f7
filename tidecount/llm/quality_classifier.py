"""Document quality by a regularised quadratic discriminant over transformed text statistics.

One pass turns each whole text into a vector of transformed statistics, kept as a narrow table. Class sums and products are added up
in Spark over all labelled rows that are not held out, by fold. The driver shrinks each class covariance
towards the pooled one and that towards a multiple of the identity, by amounts that cross-validation inside the training folds chooses, and factors both once (Cholesky). A score is the logistic of the
difference of the two log densities, each from the Mahalanobis norm by its cached factor, plus the log prior ratio.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import as_bytes, materialise, share
from ._text import chunks, join_words, space_words
from .quality_rules import repeated_words

FOLDS = 5  # by crc32 of the doc_id; fold 0 is held out of everything, shrinkage is chosen by cross-validation over the others
SHRINKAGE = tuple((pooled, sphere) for pooled in (0.0, 0.3, 0.6, 0.9) for sphere in (0.01, 0.05, 0.2))  # towards the pooled covariance, and towards a multiple of the identity
SYMBOL_BYTES = list(b"#*$%&|<>{}~^@\\_=+")
NAMES = (
    "words", "word_length", "symbols", "marks", "upper", "digits", "pipes", "distinct", "top_word", "adjacent", "repeat_lines",
    "line_words", "periods", "commas", "foreign", "entropy", "repeat_windows", "capitals",
)


def _share(part: float, whole: float) -> float:
    """A share on a scale that spreads out small ones."""
    return math.log(0.002 + part / whole) if whole else math.log(0.002)


def statistics(raws: list[bytes | None]) -> np.ndarray:
    """One row of transformed statistics for each text; null and empty texts have those of a text without words."""
    words, ends = join_words(raws, space_words)
    again = repeated_words(words, ends)
    out = np.zeros((len(raws), len(NAMES)))
    for i, raw in enumerate(raws):
        raw, own = raw or b"", words[ends[i] : ends[i + 1]]
        n, size = len(own), len(raw)
        byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        upper, lower = int(byte[65:91].sum()), int(byte[97:123].sum())
        counts = Counter(own)
        some = byte[byte > 0] / max(1, size)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        adjacent = sum(map(bytes.__eq__, own, own[1:])) if len(counts) < 0.9 * n else 0
        out[i] = (
            math.log1p(n), math.log1p((size - n) / n) if n else 0, _share(int(byte[SYMBOL_BYTES].sum()), size), _share(int(byte[33] + byte[63]), n), _share(upper, upper + lower),
            _share(int(byte[48:58].sum()), size), _share(int(byte[124]), n), math.log(len(counts)) / math.log(n) if n > 1 else 1, math.log(0.02 + counts.most_common(1)[0][1] / n) if n else 0,
            _share(adjacent, n), _share(len(lines) - len(set(lines)), len(lines)), math.log1p(n / len(lines)) if lines else 0, _share(int(byte[46]), n), _share(int(byte[44]), n),
            _share(int(byte[128:].sum()), size), float(-(some * np.log(some)).sum()), _share(int(again[i]), n), _share(upper, n),
        )
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "raw"):
        x = statistics(batch.column("raw").to_pylist())
        offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))], ["doc_id", "x"])


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(NAMES))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The products of (1, x) with itself, added up by fold and label."""
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.column("fold").to_numpy() * 2 + batch.column("label").to_numpy()
        one = np.hstack([np.ones((len(kind), 1)), _rows(batch)])
        for k in np.unique(kind):
            sums = one[kind == k].T @ one[kind == k]
            yield pa.RecordBatch.from_arrays([pa.array([k] * sums.size, pa.int32()), pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.reshape(-1))], ["kind", "at", "v"])


def _losses(models):
    """For each shrinkage the log loss of the rows by the model that is fitted without their fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = models()
        total = np.zeros(len(SHRINKAGE))
        for batch in batches:
            fold, label, x = batch.column("fold").to_numpy(), batch.column("label").to_numpy(), _rows(batch)
            for f in np.unique(fold):
                at = fold == f
                for i, model in enumerate(by[int(f)]):
                    score = np.clip(model.score(x[at]), 1e-12, 1 - 1e-12)
                    total[i] -= np.log(np.where(label[at] == 1, score, 1 - score)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "loss"])

    return run


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log constants of the classes 0 and 1; without both classes the score is 0.5."""

    mean: list[np.ndarray]
    inverse: list[np.ndarray]
    constant: list[float]

    @classmethod
    def fit(cls, sums: dict[int, np.ndarray], to_pooled: float, to_sphere: float) -> Discriminant:
        """``sums``: for each class the products of (1, x) with itself, added up."""
        if len(sums) < 2 or any(s[0, 0] < 2 for s in sums.values()):
            return cls([], [], [])
        total = sum(sums.values())
        spread = np.sqrt(np.maximum(np.diag(total)[1:] / total[0, 0] - (total[0, 1:] / total[0, 0]) ** 2, 1e-9))
        mean, cov, n = [], [], []
        for k in (0, 1):
            s = sums[k]
            n.append(s[0, 0])
            mean.append(s[0, 1:] / s[0, 0])
            cov.append((s[1:, 1:] / s[0, 0] - np.outer(mean[k], mean[k])) / np.outer(spread, spread))
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
        inverse, constant = [], []
        for k in (0, 1):
            c = (1 - to_pooled) * cov[k] + to_pooled * pooled
            c = (1 - to_sphere) * c + to_sphere * np.trace(c) / len(c) * np.eye(len(c))
            factor = np.linalg.cholesky(c)
            inverse.append(np.linalg.inv(factor) / spread)  # of the statistics as they are
            constant.append(-float(np.log(np.diag(factor)).sum()) + math.log(n[k] / (n[0] + n[1])))
        return cls(mean, inverse, constant)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.mean:
            return np.full(len(x), 0.5)
        log = [self.constant[k] - 0.5 * (((x - self.mean[k]) @ self.inverse[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Discriminant = model()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.score(_rows(batch)))], ["doc_id", "score"])

    return run


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def _added(parts: list[dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    return {k: sum(p[k] for p in parts if k in p) for k in (0, 1) if any(k in p for p in parts)}


def fit(features: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """A discriminant from all labelled rows that are not held out, with the shrinkage of the least cross-validated log loss (of equals the first).

    A few thousand sums and one loss for each shrinkage reach the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"), fold().cast("int").alias("fold")).filter("label in (0, 1) AND fold > 0")
    rows = materialise(features.join(known, "doc_id").select("fold", "label", "x"))
    side, sums = len(NAMES) + 1, {f: {} for f in range(1, FOLDS)}
    for r in rows.mapInArrow(_summed, "kind int, at int, v double").groupBy("kind", "at").agg(F.sum("v").alias("v")).collect():
        sums[r.kind // 2].setdefault(r.kind % 2, np.zeros(side * side))[r.at] = r.v
    sums = {f: {k: v.reshape(side, side) for k, v in s.items()} for f, s in sums.items()}
    without = {f: _added([s for g, s in sums.items() if g != f]) for f in sums}
    models = share(features.sparkSession, {f: [Discriminant.fit(s, *how) for how in SHRINKAGE] for f, s in without.items()})
    losses = rows.mapInArrow(_losses(models), "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).collect()
    models.drop()
    best = min(losses, key=lambda r: (round(r.loss, 6), r.i)).i if losses else 0
    return Discriminant.fit(_added(list(sums.values())), *SHRINKAGE[best])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs(doc_id, text, ...)``, learned from ``labels(doc_id, quality)``.

    Only statistics of the text enter a score. Null and empty texts get the score of a text without words; a null doc_id is
    not held out and has no label; labels other than 0 and 1 are ignored; without both labels every score is 0.5.
    """
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("raw"))
    features = materialise(raw.mapInArrow(_featured, "doc_id long, x array<double>"))
    model = share(docs.sparkSession, fit(features, labels))
    scored = features.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
