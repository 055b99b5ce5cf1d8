"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each document becomes ``FEATURES`` numbers: logarithms of sizes and logits of shares, which are near to normal inside a class. A
class has a mean and a covariance that is shrunk towards the pooled one and towards a multiple of the identity. The
score is the posterior of class 1 from the difference of the two normal log densities, whose Mahalanobis terms use Cholesky
factors computed once. The fit needs only counts, sums and sums of products per class, which tasks add up before the
shuffle; no row reaches the driver.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellset.llm.common import byte_text, fresh, in_small_batches, texts_of
from cellset.session import materialize

FEATURES = ("words", "word_bytes", "spread_of_word_bytes", "upper", "symbols", "digits", "variety", "top_word", "repeats_before",
            "line_variety", "words_per_line", "marks_alone", "stops", "commas", "short_words", "cased_starts")
#: Shares are moved off 0 and 1 by this much before their logit.
EDGE = 0.02
#: Weights of the pooled covariance and of the identity in a class covariance.
POOLED, IDENTITY = 0.3, 0.02
THRESHOLD = 0.7
HELD_OUT_OF, HELD_OUT = 4, 2

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
SPACE = b" \t\n\r\x0b\x0c"
PLAIN_MARKS = b".,;:'\"-()"
SYMBOLS = bytes(c for c in range(33, 127) if c not in UPPER + LOWER + DIGITS + PLAIN_MARKS)


def dropped(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def logit(share: float) -> float:
    return float(np.log((share + EDGE) / (1 - share + EDGE)))


def statistics(text: bytes) -> list[float]:
    """The features of one whole text; every one is defined for empty texts too."""
    words = text.split()
    n = len(words)
    some = max(n, 1)
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper, lower = dropped(text, UPPER), dropped(text, LOWER)
    visible = max(len(text) - dropped(text, SPACE), 1)
    again = sum(map(bytes.__eq__, words, words[1:]))
    marks = sum(v for w, v in counts.items() if len(w) <= 3 and not any(c > 127 or c in DIGITS + UPPER + LOWER for c in w))
    cased = sum(v for w, v in counts.items() if 65 <= w[0] <= 90)
    return [
        float(np.log1p(n)), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())), logit(upper / max(upper + lower, 1)),
        logit(dropped(text, SYMBOLS) / visible), logit(dropped(text, DIGITS) / visible),
        float(np.log1p(len(counts)) / np.log1p(some)), logit(max(counts.values(), default=0) / some), logit(again / some),
        logit(len(set(lines)) / max(len(lines), 1)), float(np.log1p(n / max(len(lines), 1))), logit(marks / some),
        logit(min(text.count(b".") / some, 1.0)), logit(min(text.count(b",") / some, 1.0)),
        logit(float((lengths <= 3).mean())), logit(cased / some),
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def features_of(text: pa.Array) -> pa.Array:
    return pa.array([statistics(x) for x in texts_of(text)], pa.list_(pa.float64()))


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log-density constants of classes 0 and 1 in standardised features."""
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    constants: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = (rows - self.centre) / self.scale
        density = [c - 0.5 * (((z - m) @ w.T) ** 2).sum(axis=1)
                   for m, w, c in zip(self.means, self.whiten, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def moments(rows: DataFrame, label: str, features: str) -> DataFrame:
    """``label, place, value``: per class the flattened sums of ``x xT`` where ``x`` is the features and a 1."""
    def run(iterator):
        sums = {}
        for batch in iterator:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            values = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(labels), -1)
            for kind in np.unique(labels):
                x = np.column_stack([values[labels == kind], np.ones((labels == kind).sum())])
                sums[int(kind)] = sums.get(int(kind), 0) + x.T @ x
        for kind, total in sums.items():
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()),
                                              pa.array(flat)], ["label", "place", "value"])

    return rows.select(F.col(label).cast("int"), features).mapInArrow(run, "label int, place int, value double").groupBy(
        "label", "place").agg(F.sum("value").alias("value"))


def fitted(rows: DataFrame, label: str = "label", features: str = "features", pooled: float = POOLED,
           identity: float = IDENTITY) -> Model:
    """Model of labelled rows (labels 0 and 1). A class without rows gets the pooled covariance and half a row of weight."""
    d = len(FEATURES)
    sums = np.zeros((2, d + 1, d + 1))
    for r in moments(rows, label, features).collect():  # 2 * (d + 1)**2 rows at most
        if r.label in (0, 1):
            sums[r.label].flat[r.place] = r.value
    counts = sums[:, d, d]
    total = max(counts.sum(), 1.0)
    centre = sums[:, d, :d].sum(axis=0) / total
    scale = np.sqrt(np.maximum(np.diag(sums.sum(axis=0))[:d] / total - centre ** 2, 1e-6))
    means = np.array([(s[d, :d] / max(n, 1.0) - centre) / scale if n else np.zeros(d) for s, n in zip(sums, counts, strict=True)])
    scatter = np.array([((s[:d, :d] - np.outer(s[d, :d], s[d, :d]) / max(n, 1.0)) / np.outer(scale, scale))
                        for s, n in zip(sums, counts, strict=True)])
    common = scatter.sum(axis=0) / total
    whiten, constants = [], []
    for s, n in zip(scatter, counts, strict=True):
        own = s / n if n else common
        own = (1 - pooled) * own + pooled * common
        own = (1 - identity) * own + identity * max(np.trace(own) / d, 1e-3) * np.eye(d)
        lower = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(lower))
        constants.append(np.log((n + 0.5) / (total + 1)) - np.log(np.diag(lower)).sum())
    return Model(centre, scale, means, np.array(whiten), np.array(constants))


def scorer(model: Model):
    @F.arrow_udf(T.DoubleType())
    def score(features: pa.Array) -> pa.Array:
        rows = np.array(features.to_pylist(), np.float64).reshape(len(features), len(FEATURES))
        return pa.array(model.score(rows), pa.float64())
    return score


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned from: CRC-32 of the id as text, modulo 4, is 2; a NULL id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def training_rows(features: DataFrame, labels: DataFrame, id_col: str, label_col: str = "quality") -> DataFrame:
    """``label, features`` of the labelled rows that may be learned from; repeated labels count by their majority."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_label_id")).agg(
        (F.avg(label_col) >= 0.5).cast("int").alias("label"))
    open_rows = features.where(~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col("features"))
    return open_rows.join(known, F.col("_id") == F.col("_label_id")).select("label", "features")


def featured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table ``id, features`` with one row per row of ``df``; NULL text counts as empty."""
    return materialize(in_small_batches(df).select(F.col(id_col), features_of(byte_text(text_col)).alias("features")))


def scored(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` for every row of ``df``; ``labels`` has ``doc_id, quality``.

    Empty and NULL texts are scored like any other. Repeated ids are scored by their own texts. Without any labels
    the score is one constant. An empty table gives an empty result; other columns of ``df`` are ignored.
    """
    rows = featured(df, id_col, text_col)
    score = scorer(fitted(training_rows(rows, labels, id_col)))
    out = rows.select(F.col(id_col), held_out(id_col).alias("held_out"), score("features").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``df`` that the classifier doesn't reject, columns unchanged; the text isn't shuffled."""
    score = scorer(fitted(training_rows(featured(df, id_col, text_col), labels, id_col)))
    name, = fresh(df, "_score")
    return df.withColumn(name, score(features_of(byte_text(text_col)))).where(F.col(name) >= threshold).drop(name)
