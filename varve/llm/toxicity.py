"""Classifier chains for toxicity.

The categories are predicted one after another by logistic models over words
and word beginnings; each model also takes the probabilities of the categories
before it. For training these are out-of-fold predictions, so a later model
sees earlier ones as wrong as they will be on new texts; each fold selects its
own features. A category's threshold is the one with the best F1 out of fold.

Training takes at most ``sample`` labelled documents (chosen by a hash of
doc_id); scoring covers every document and its whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scan import slices
from ._tables import documents

#: The chain in its order: a name, and the SQL condition on a row of labels. The labels tell two things apart, so the third category is both together.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_low_quality", "toxic = 1 and quality = 0"))
_STRIP = ".,;:!?\"'()[]{}#*$%&|<>-_=/\\"
_LENGTHS = (4, 5, 6, 7)


def features_of(word: str) -> list[int]:
    """Numbers of a word's features: itself, and its beginnings."""
    word = word.strip(_STRIP)
    if not word or not word[0].isalpha():
        return []
    return [zlib.crc32(b"w" + word.encode())] + [zlib.crc32(b"b" + word[:k].encode()) for k in _LENGTHS if len(word) >= k]


def value(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A feature's value: how often it comes in a hundred words, one at most, and half for coming at all."""
    return (0.5 + 0.5 * np.minimum(1.0, 100.0 * count / np.maximum(1, words))).astype(np.float32)


@dataclass
class Link:
    """A category's model."""

    columns: np.ndarray  # feature numbers, sorted
    weights: np.ndarray
    earlier: np.ndarray
    bias: float
    threshold: float = 0.5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Sample:
    """Feature counts of the training documents, as (document, feature, value)."""

    def __init__(self, rows: list[tuple[bytes, bytes, int]]):
        sizes = np.array([len(r[0]) // 4 for r in rows], np.int64)
        self.n = len(rows)
        self.doc = np.repeat(np.arange(self.n), sizes)
        raw = np.frombuffer(b"".join(r[0] for r in rows), "<u4")
        count = np.frombuffer(b"".join(r[1] for r in rows), "<i4")
        self.names, self.feature = np.unique(raw, return_inverse=True)
        self.value = value(count, np.repeat(np.array([r[2] for r in rows]), sizes))

    def select(self, y: np.ndarray, use: np.ndarray, most: int) -> np.ndarray:
        """The features, by place in names, that tell the classes apart best by chi-squared on value sums, with five documents at least."""
        on = use[self.doc]
        f, d = self.feature[on], self.doc[on]
        df = np.bincount(f, minlength=len(self.names))
        pos = np.bincount(f, weights=y[d], minlength=len(self.names))
        n, p = use.sum(), y[use].sum()
        expect = df * p / max(1, n)
        chi = np.where(df >= 5, (pos - expect) ** 2 / np.maximum(1e-9, expect * (1 - df / max(1, n))), -1.0)
        order = np.lexsort((np.arange(len(chi)), -chi))[:most]
        return np.sort(order[chi[order] > 6])

    def matrix(self, columns: np.ndarray) -> np.ndarray:
        at = np.full(len(self.names), -1)
        at[columns] = np.arange(len(columns))
        on = at[self.feature] >= 0
        x = np.zeros((self.n, len(columns)), np.float32)
        x[self.doc[on], at[self.feature[on]]] = self.value[on]
        return x


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 100, penalty: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model by penalised gradient descent."""
    n, d = x.shape
    w, b = np.zeros(d, np.float32), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    for step in range(1, rounds + 1):
        miss = ((_sigmoid(x @ w + b) - y) / max(1, n)).astype(np.float32)
        g, gb = x.T @ miss + penalty * w, float(miss.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1
        w = (w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return w, b


def train_chain(sample: Sample, labels: np.ndarray, fold: np.ndarray, most: int = 1024) -> tuple[list[Link], np.ndarray]:
    """The chain's models and the out-of-fold probabilities; labels: a column for each category."""
    out, chain = np.zeros(labels.shape), []
    for c in range(labels.shape[1]):
        y, earlier = labels[:, c].astype(np.float64), 4.0 * (out[:, :c] - 0.5).astype(np.float32)
        for k in np.unique(fold):
            use = fold != k
            x = np.hstack([sample.matrix(sample.select(y, use, most)), earlier])
            w, b = fit(x[use], y[use])
            out[~use, c] = _sigmoid(x[~use] @ w + b)
        columns = sample.select(y, np.ones(sample.n, bool), most)
        w, b = fit(np.hstack([sample.matrix(columns), earlier]), y)
        order = np.argsort(-out[:, c], kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, sample.n + 1) + max(1.0, y.sum()))
        best = int(np.argmax(f1)) if sample.n else 0
        level = float(out[order[best], c]) if sample.n and y.sum() else 2.0
        chain.append(Link(sample.names[columns], w[: len(columns)], w[len(columns) :], b, level))
    return chain, out


def counts(texts: list[str], known: _Known) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature place, count) of the known features in texts, and the words of each."""
    words = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    if len(known) >= known.entries:  # never between texts whose places are in use
        known.clear()
        known.lists = [[]]
    at = np.fromiter((known[w] for ws in words for w in ws), np.int64, int(n.sum()))
    hit = np.flatnonzero(at)
    doc = np.repeat(np.arange(len(texts)), n)[hit]
    lists = [known.lists[i] for i in at[hit].tolist()]
    size = np.array([len(x) for x in lists], np.int64)
    feature = np.array([f for x in lists for f in x], np.int64)
    key, count = np.unique(np.repeat(doc, size) << 32 | feature, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, count, n


class _Known(dict):
    """The place in ``lists`` of the features of a word, of those in ``names`` (None: all); 0 if it has none."""

    def __init__(self, names: np.ndarray | None, entries: int = 500_000):
        super().__init__()
        self.names = None if names is None else {int(f): i for i, f in enumerate(names)}
        self.lists: list[list[int]] = [[]]
        self.entries = entries

    def __missing__(self, word: str) -> int:
        own = features_of(word)
        if self.names is not None:
            own = [self.names[f] for f in own if f in self.names]
        if own:
            self.lists.append(own)
        self[word] = place = len(self.lists) - 1 if own else 0
        return place


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = 3000, folds: int = 5) -> list[Link]:
    """Fits the chain on at most ``sample`` labelled documents; an empty chain without any."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.coalesce(F.expr(sql), F.lit(False)).cast("int")).alias(f"label_{i}") for i, (_, sql) in enumerate(categories)])
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    names = [f"label_{i}" for i in range(len(categories))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            doc, feature, count, n = counts([t or "" for t in part.column("text").to_pylist()], _Known(None))
            edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
            cut = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), cut(feature, "<u4"), cut(count, "<i4"), pa.array(n), *(part.column(c) for c in names)], names=["doc_id", "features", "counts", "words", *names])

    schema = "doc_id long, features binary, counts binary, words long, " + ", ".join(f"{c} int" for c in names)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", *names).mapInArrow(run, schema).orderBy(F.xxhash64("doc_id"), "doc_id", "words", "features", "counts").limit(sample).toPandas()
    if not len(rows):
        return []
    data = Sample(list(zip(rows.features, rows.counts, rows.words, strict=True)))
    return train_chain(data, rows[names].to_numpy(), np.arange(data.n) % folds)[0]


def score(docs: DataFrame, chain: list[Link], names: list[str]) -> DataFrame:
    """doc_id, n_words, and for each category p_<name> and <name>, whether it reaches the threshold.

    A null or empty text has no features, and so the models' biases alone;
    without a chain every probability is 0. A text of any length is scored as
    a whole. Repeated rows are scored each; an empty table gives no row; other
    columns are ignored.
    """
    columns = np.unique(np.concatenate([link.columns for link in chain])) if chain else np.zeros(0, np.uint32)
    place = [np.searchsorted(columns, link.columns) for link in chain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(columns)
        for part in slices(batches, "text"):
            doc, feature, count, n = counts([t or "" for t in part.column("text").to_pylist()], known)
            v = value(count, n[doc])
            p = np.zeros((part.num_rows, len(names)))
            for c, (link, at) in enumerate(zip(chain, place, strict=True)):
                weight = np.zeros(len(columns))
                weight[at] = link.weights
                p[:, c] = _sigmoid(np.bincount(doc, weights=weight[feature] * v, minlength=part.num_rows) + 4.0 * (p[:, :c] - 0.5) @ link.earlier + link.bias)
            level = [link.threshold for link in chain] or [2.0] * len(names)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n), *(pa.array(x) for c in range(len(names)) for x in (p[:, c], p[:, c] >= level[c]))], names=["doc_id", "n_words", *(x for name in names for x in (f"p_{name}", name))])

    schema = "doc_id long, n_words long, " + ", ".join(f"p_{name} double, {name} boolean" for name in names)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and verdicts of every document. Nulls, repeats, long texts and empty tables: see score()."""
    docs = documents(spark, sf_dir)
    chain = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, chain, [name for name, _ in CATEGORIES])


QUERIES = {"op4_toxicity_chain": op4_toxicity_chain}
SQL: dict[str, str] = {}
