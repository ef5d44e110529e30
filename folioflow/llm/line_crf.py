"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line gets the label good or bad. A line's features describe it, its two neighbours and how it repeats
within the text; two weights a pair of labels join neighbouring lines. Training maximises the conditional likelihood of
the labelled texts' line labels (every line has its text's label) on a bounded sample of ``MAX_TRAIN`` texts of each label, taken in the
order of a hash of their ids; of a sampled id's texts one, and none of more than ``MAX_LINES`` lines, so what the driver gathers has a fixed bound. A text's score is the mean of its lines' marginal probabilities of ``good`` from
the forward-backward recursions, weighted by the lines' lengths.

Lines are what ``\\n`` separates and has a character other than white space. Scoring maps over the texts; nothing is shuffled and
the model has a fixed size.

Defined results: a null or blank text has one empty line, so that it gets the model's score of nothing. Labels of
one id that differ: the text counts as good only if all say so. Without labels of both kinds all scores are
0.5. A null id is held out. Repeated rows keep their rows. Bytes that are not
UTF-8 are read as U+FFFD. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import only, small, texts_of

MAX_TRAIN = 800  #: texts of each label
MAX_LINES = 400  #: of a text that is trained on
STEPS, RATE, DECAY = 120, 0.1, 1e-3
THRESHOLD = 0.3
_CAPITALS, _DIGITS, _SYMBOLS, _PUNCT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b".,;:!?"
_ONE = 14


def line_features(lines: list[str]) -> np.ndarray:
    """Features of each line, in UTF-8 bytes, by itself and within its text, then the means of both neighbours."""
    raw = [x.encode() for x in lines]
    seen = Counter(raw) if len(raw) > 1 else {}
    words_of = [x.split() for x in raw]
    total, different = sum(map(len, words_of)), len(set().union(*words_of))
    distinct, many = different / total if total >= 20 else 1.0, min(1.0, len(lines) / 20)
    own = []
    for x, ws in zip(raw, words_of, strict=True):
        n, k = len(x) or 1, len(ws) or 1
        symbols = len(x) - len(x.translate(None, _SYMBOLS))
        own.append((
            1.0,
            min(1.0, n / 400),
            min(1.0, len(ws) / 50),
            (len(x) - len(x.translate(None, _CAPITALS))) / n,
            (len(x) - len(x.translate(None, _DIGITS))) / n,
            symbols / n,
            min(1.0, symbols / k),
            min(1.0, (len(x) - len(x.translate(None, _PUNCT))) / k),
            min(1.0, x.count(b"!") / k),
            len(set(ws)) / k if ws else 1.0,
            1.0 if seen and seen[x] > 1 else 0.0,
            distinct,
            many,
            1.0 if x.endswith((b".", b"!", b"?")) else 0.0,
        ))
    own = np.array(own)
    before, after = np.vstack([own[:1], own[:-1]]), np.vstack([own[1:], own[-1:]])
    return np.hstack([own, (before + after)[:, 1:] / 2])


def lines_of(text: str | None) -> list[str]:
    return [x for x in (text or "").split("\n") if x and not x.isspace()] or [""]


SIZE = 2 * _ONE - 1


class Model:
    """``weights``: of label good against bad, for each feature; ``pairs``: for staying in bad, in good, and changing."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.pairs, self.mean, self.scale = weights, pairs, mean, scale

    def potentials(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale @ self.weights, -30, 30)

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """P(good) of each line."""
        return chain(self.potentials(features).tolist(), *self.pairs.tolist())

    def score(self, text: str | None) -> float:
        lines = lines_of(text)
        weight = np.array([len(x) or 1 for x in lines], float)
        return float(np.clip(self.marginals(line_features(lines)) @ weight / weight.sum(), 0, 1))


def chain(potentials: list[float], bad: float, good: float, change: float) -> np.ndarray:
    """Forward-backward for one chain: the marginals of good. The recursions carry P(good) of scaled pairs."""
    n = len(potentials)
    eb, eg, ec = math.exp(bad), math.exp(good), math.exp(change)
    g = [1 / (1 + math.exp(-x)) for x in potentials]
    if n == 1:
        return np.array(g)
    p = g[0]
    forward = [p]
    for x in g[1:]:
        s = ((1 - p) * ec + p * eg) * x
        p = s / (s + ((1 - p) * eb + p * ec) * (1 - x))
        forward.append(p)
    q = 0.5
    for i in range(n - 1, -1, -1):
        p, x = forward[i], g[i]
        s = p * q
        forward[i] = s / (s + (1 - p) * (1 - q))
        vb, vg = (1 - x) * (1 - q), x * q
        s = ec * vb + eg * vg
        q = s / (s + eb * vb + ec * vg)
    return np.array(forward)


def train(texts: list[tuple[np.ndarray, int]], steps: int = STEPS) -> Model:
    """``texts``: line features and label (1 good). Both labels weigh as their texts do; Adam on the exact gradient, a line a unit."""
    blank = Model(np.zeros(SIZE), np.zeros(3), np.zeros(SIZE), np.ones(SIZE))
    if len({y for _, y in texts}) < 2:
        return blank
    rows = np.vstack([x for x, _ in texts])
    mean, scale = rows.mean(0), rows.std(0) + 1e-6
    mean[0], scale[0] = 0, 1
    rows = (rows - mean) / scale
    lengths = np.array([len(x) for x, _ in texts])
    label = np.repeat([float(y) for _, y in texts], lengths)
    share = np.repeat(1 / lengths, lengths) / len(texts)
    w = np.zeros(SIZE + 3)
    first, second = np.zeros_like(w), np.zeros_like(w)
    starts = np.cumsum(lengths) - lengths
    # all texts of one length step through the recursions together
    batches = [starts[lengths == n][:, None] + np.arange(n) for n in np.unique(lengths)]
    good_text = np.array([y for _, y in texts])
    for t in range(1, steps + 1):
        p = np.clip(rows @ w[:SIZE], -30, 30)
        grad = np.zeros_like(w)
        expected = np.zeros(len(p))
        for at, n in zip(batches, np.unique(lengths), strict=True):
            expected[at], counts = chains(p[at], *w[SIZE:])
            y = good_text[lengths == n]
            seen = np.stack([(1 - y) * (n - 1), y * (n - 1), 0 * y], 1)
            grad[SIZE:] += ((seen - counts) / n).sum(0) / len(texts)
        grad[:SIZE] = rows.T @ ((label - expected) * share)
        grad -= DECAY * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w + RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w[SIZE:] = np.clip(w[SIZE:], -3, 3)
    return Model(w[:SIZE], w[SIZE:], mean, scale)


def chains(p: np.ndarray, bad: float, good: float, change: float) -> tuple[np.ndarray, np.ndarray]:
    """``chain`` for many chains of one length at once."""
    m, n = p.shape
    g = 1 / (1 + np.exp(-p))
    v = np.stack([1 - g, g], 2)
    step = np.exp(np.array([[bad, change], [change, good]]))
    forward = np.empty_like(v)
    forward[:, 0] = v[:, 0]
    for i in range(1, n):
        x = forward[:, i - 1] @ step * v[:, i]
        forward[:, i] = x / x.sum(1, keepdims=True)
    after, out, counts = np.ones((m, 2)), np.empty((m, n)), np.zeros((m, 3))
    for i in range(n - 1, -1, -1):
        both = forward[:, i] * after
        out[:, i] = both[:, 1] / both.sum(1)
        if i:
            w = v[:, i] * after
            pair = forward[:, i - 1, :, None] * step * w[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            counts += np.stack([pair[:, 0, 0], pair[:, 1, 1], pair[:, 0, 1] + pair[:, 1, 0]], 1)
            after = w @ step
            after /= after.sum(1, keepdims=True)
    return out, counts


def held_out(id_column):
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Train on labelled texts whose id is not held out, at most ``max_train`` of each label."""
    marks = only(labels, id_col, label_col).toDF("label_id", "y").where("label_id is not null and y is not null").where(~held_out(F.col("label_id")))
    marks = marks.groupBy("label_id").agg(F.min("y").alias("y"))
    kinds = [marks.where(c).orderBy(F.xxhash64(F.col("label_id").cast("string")), "label_id").limit(max_train) for c in ("y >= 1", "y < 1")]
    chosen = kinds[0].unionByName(kinds[1]).select("label_id", (F.col("y") >= 1).cast("int").alias("y"))

    def run(batches):
        for batch in batches:
            lines = [lines_of(t) for t in texts_of(batch.column(0))]
            rows = [line_features(x).astype(np.float32).tobytes() if len(x) <= MAX_LINES else None for x in lines]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *batch.columns[1:]], ["x", "y", "at", "label_id"])

    texts = only(docs, id_col, text_col).toDF("id", "text").join(small(chosen, 16), F.col("id") == F.col("label_id"))
    kind = marks.schema["label_id"]
    rows = texts.select("text", "y", F.xxhash64("text").alias("at"), "label_id").mapInArrow(run, StructType([StructField("x", BinaryType()), StructField("y", IntegerType()), StructField("at", LongType()), kind]))
    rows = rows.where("x is not null").groupBy("label_id").agg(F.min(F.struct("at", "y", "x")).alias("one")).select("one.*").collect()  # a row for each chosen id
    rows.sort(key=lambda r: (r.at or 0, r.y))
    return train([(np.frombuffer(r.x, np.float32).reshape(-1, SIZE).astype(float), r.y) for r in rows])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, ``held_out``, ``score``, ``predicted``, and ``n_lines``."""
    kind = only(docs, id_col).toDF("id").schema[0]

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            scores = [model.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([len(lines_of(t)) for t in texts], pa.int64())], ["id", "score", "n_lines"])

    out = only(docs, id_col, text_col).mapInArrow(run, StructType([kind, StructField("score", DoubleType()), StructField("n_lines", LongType())]))
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines")


def good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``threshold``."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([model.score(t) >= threshold for t in texts_of(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
