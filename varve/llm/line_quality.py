"""Line sequence labelling for quality: a linear-chain conditional random field marks lines as content or boilerplate.

The field is fitted on a bounded sample of labelled documents, cut into
segments of lines. In a document of bad quality every line is boilerplate; in a
good one the lines that repeat an earlier one, or are mostly symbols, bars or
digits, are boilerplate too, so the labels change within documents and the
field learns when they do. Viterbi decoding then labels the lines of all
documents, and the share of a document's words in content lines decides whether
it stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scan import SPACE, U, Words, _power, _BYTE, grams, mix, slices
from ._tables import documents

FEATURES = 28
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, content_lines long, content_words long, kept boolean"


def _bytes_in(chars: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars.encode())] = 1
    return out


_SYMBOL, _PIPE, _MARK, _STOP = _bytes_in("#*$%&|<>"), _bytes_in("|"), _bytes_in("!"), _bytes_in(".,;:?")
_UPPER, _DIGIT, _CODE = _bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes_in("0123456789"), _bytes_in('=/{}"@_\\')
_LETTER = _UPPER | _bytes_in("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = 1
_END = _bytes_in(".!?")


class Lines:
    """Counts of the documents in a slice, and features of their lines."""

    def __init__(self, text: pa.Array):
        w = Words(text)
        raw, n_docs = w.raw, len(text)
        self.n_words = w.counts
        head = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=head[1:])
        per = lambda values, first: np.append(0, np.cumsum(values))[first[1:]] - np.append(0, np.cumsum(values))[first[:-1]]
        self.word_chars = per(head[w.end] - head[w.start], w.first)
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(_SYMBOL[raw], out=total[1:])
        self.n_symbols = total[w.offsets[1:]] - total[w.offsets[:-1]]
        hashes = w.hashes()
        repeated = np.zeros(len(w) + 1, np.int64)
        if len(w) > 2:
            tri = grams(hashes, 3) ^ mix(w.row[:-2].astype(np.uint64))
            inside = w.row[:-2] == w.row[2:]
            at = np.flatnonzero(inside)
            _, which, often = np.unique(tri[at], return_inverse=True, return_counts=True)
            hit = at[often[which] > 1]
            np.add.at(repeated, hit, 1)
            np.add.at(repeated, hit + 3, -1) if not len(hit) or hit[-1] + 3 <= len(w) else None
        covered = np.cumsum(repeated)[:-1] > 0
        self.n_repeat_words = per(covered, w.first)
        # lines: a document has one more than it has line feeds
        feeds = np.flatnonzero(raw == 10)
        feed_row = np.searchsorted(w.offsets, feeds, "right") - 1
        start = np.concatenate([w.offsets[:-1], feeds + 1])
        row = np.concatenate([np.arange(n_docs), feed_row])
        order = np.lexsort((start, row))
        self.start, self.row = start[order], row[order]
        self.first = np.searchsorted(self.row, np.arange(n_docs + 1))
        last = np.ones(len(self.row), bool)
        last[:-1] = self.row[1:] != self.row[:-1]
        self.stop = np.where(last, w.offsets[self.row + 1], np.append(self.start[1:], 0) - 1)
        word_at = np.searchsorted(w.start, self.start)
        word_to = np.searchsorted(w.start, self.stop)
        self.words = word_to - word_at
        up = _power("up", max(1, len(raw)))
        summed = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=summed[1:])
        down = _power("down", len(raw) + 1)
        own = mix((summed[self.stop] - summed[self.start]) * down[self.start] + (self.stop - self.start).astype(np.uint64))
        key = mix(own + mix(self.row.astype(np.uint64) + U(1)))
        key_order = np.argsort(key, kind="stable")
        dup = np.zeros(len(key), bool)
        dup[key_order[1:]] = key[key_order[1:]] == key[key_order[:-1]]
        self.dup = dup & (self.words > 0)
        self.n_dup_lines = np.bincount(self.row[self.dup], minlength=n_docs)
        # features
        count = lambda table: self._sums(table[raw])
        chars = (self.stop - self.start - count(SPACE.astype(np.uint8))).astype(np.float64)
        letters = count(_LETTER)
        one = np.maximum(1.0, chars)
        words = np.maximum(1.0, self.words)
        cov = np.append(0, np.cumsum(covered))
        again = (cov[word_to] - cov[word_at]) / words
        symbols, pipes, marks, stops, upper, digits, code = (count(t) for t in (_SYMBOL, _PIPE, _MARK, _STOP, _UPPER, _DIGIT, _CODE))
        ends = np.zeros(len(words), bool)
        some = self.words > 0
        ends[some] = _END[raw[w.end[word_to[some] - 1] - 1]] > 0
        share, up_share, mean = symbols / one, upper / np.maximum(1.0, letters), chars / words
        self.features = np.stack([
            np.ones(len(words)), share > 0.01, share > 0.05, share > 0.15, pipes / words > 0.1, pipes / words > 0.4, up_share > 0.15, up_share > 0.4, up_share > 0.8, marks / words > 0.05, marks / words > 0.4,
            digits / one > 0.05, digits / one > 0.3, code / one > 0.02, code / one > 0.1, self.words == 0, self.words <= 3, self.words <= 8, self.words >= 40, mean > 9, mean < 3, stops / words > 0.03, stops / words > 0.3,
            ends, self.dup, again > 0.1, again > 0.5, (letters / one) < 0.6,
        ], 1).astype(np.float32)

    def _sums(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.stop] - total[self.start]


class Field:
    """A linear-chain conditional random field of two labels, 1 for content."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, begin: np.ndarray):
        self.weights, self.moves, self.begin = weights, moves, begin

    @staticmethod
    def likelihood(params: np.ndarray, features: np.ndarray, gold: np.ndarray, real: np.ndarray, at: np.ndarray, scale: np.ndarray) -> tuple[float, np.ndarray]:
        """The weighted log likelihood of sequences side by side and its gradient.

        ``at`` has the line at each step of each sequence, ``real`` where there
        is one, ``gold`` its label, ``scale`` each sequence's weight.
        """
        longest, n = real.shape
        d = features.shape[1]
        w, moves, begin = params[:d], params[d : d + 4].reshape(2, 2), params[d + 4 :]
        emit = np.zeros((longest, n, 2))
        emit[:, :, 1] = (features @ w)[at]
        emit[~real] = 0
        alpha = np.empty((longest, n, 2))
        alpha[0] = begin + emit[0]
        for t in range(1, longest):
            alpha[t] = np.where(real[t][:, None], np.logaddexp(alpha[t - 1][:, :1] + moves[0], alpha[t - 1][:, 1:] + moves[1]) + emit[t], alpha[t - 1])
        beta = np.zeros((longest, n, 2))
        pair = np.zeros((2, 2))
        norm = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
        for t in range(longest - 1, 0, -1):
            after = moves[None] + (emit[t] + beta[t])[:, None, :]
            joint = np.exp(alpha[t - 1][:, :, None] + after - norm[:, None, None]) * (real[t] * scale)[:, None, None]
            pair += joint.sum(axis=0)
            beta[t - 1] = np.where(real[t][:, None], np.logaddexp(after[:, :, 0], after[:, :, 1]), beta[t])
        p = np.exp(alpha + beta - norm[None, :, None]) * (real * scale)[:, :, None]
        miss = np.bincount(at[real], weights=((gold * scale)[real] - p[:, :, 1][real]), minlength=len(features))
        seen = np.zeros((2, 2))
        both = real[1:]
        np.add.at(seen, (gold[:-1][both], gold[1:][both]), np.broadcast_to(scale, both.shape)[both])
        first = np.array([scale[gold[0] == y].sum() for y in (0, 1)])
        grad = np.concatenate([features.T @ miss, (seen - pair).ravel(), first - p[0].sum(axis=0)])
        value = float((emit[:, :, 1] * gold * scale)[real].sum() + (seen * moves).sum() + (first * begin).sum() - (scale * norm).sum())
        return value, grad

    @classmethod
    def fit(cls, features: np.ndarray, labels: np.ndarray, first: np.ndarray, rounds: int = 150, penalty: float = 1e-5, mixed_weight: float = 8.0) -> Field:
        """Gradient ascent on the penalised likelihood; ``first`` has where each sequence starts, and the end."""
        n, longest = len(first) - 1, int(np.diff(first).max())
        place = np.full((longest, n), -1)
        for i in range(n):
            place[: first[i + 1] - first[i], i] = np.arange(first[i], first[i + 1])
        real, at = place >= 0, np.maximum(place, 0)
        # sequences of mostly content and the others weigh the same in all
        kind = (np.add.reduceat(labels, first[:-1]) * 2 > np.diff(first)).astype(np.int64)
        share = np.clip(np.array([(kind == y).sum() for y in (0, 1)]), 1, None) / n
        total = np.add.reduceat(labels, first[:-1])
        mixed = (total > 0) & (total < np.diff(first))  # the few that tell when labels change
        scale = (0.5 / share)[kind] * np.where(mixed, mixed_weight, 1.0)
        params = np.zeros(features.shape[1] + 6)
        velocity, square = np.zeros_like(params), np.zeros_like(params)
        d, norm = features.shape[1], scale.sum() * longest**0.5
        for step in range(1, rounds + 1):
            grad = cls.likelihood(params, features, labels[at], real, at, scale)[1] / norm - penalty * params
            velocity = 0.9 * velocity + 0.1 * grad
            square = 0.99 * square + 0.01 * grad**2
            params += 0.15 * (velocity / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        return cls(params[:d], params[d : d + 4].reshape(2, 2), params[d + 4 :])

    def viterbi(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best labels of all sequences, step by step side by side."""
        emit = features @ self.weights.astype(np.float32)
        sizes = np.diff(first)
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = first[:-1][order], sizes[order]
        labels, back = np.zeros(len(emit), np.int8), np.zeros((len(emit), 2), np.int8)
        n = int((sizes > 0).sum())
        best = np.zeros((len(sizes), 2))
        best[:n] = self.begin
        best[:n, 1] += emit[begins[:n]]
        for t in range(1, int(sizes[0]) if n else 0):
            n = int(np.searchsorted(-sizes, -t, "left"))
            ways = best[:n, :, None] + self.moves
            back[begins[:n] + t] = ways[:, 1] > ways[:, 0]
            best[:n] = ways.max(axis=1)
            best[:n, 1] += emit[begins[:n] + t]
        now = (best[:, 1] > best[:, 0]).astype(np.int8)
        for t in range(int(sizes[0]) - 1 if len(sizes) else -1, -1, -1):
            n = int(np.searchsorted(-sizes, -t, "left"))
            labels[begins[:n] + t] = now[:n]
            if t:
                now[:n] = back[begins[:n] + t, now[:n]]
        return labels


def line_labels(x: Lines, good: np.ndarray) -> np.ndarray:
    """1 for content: lines of good documents, but for those that repeat an earlier one or are mostly symbols, bars or digits."""
    f = {name: x.features[:, i] > 0 for name, i in (("symbols", 3), ("bars", 5), ("digits", 12), ("again", 24))}
    return (good[x.row] & ~(f["symbols"] | f["bars"] | f["digits"] | f["again"])).astype(np.int8)


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, segment: int = 24, segments: int = 6000) -> Field | None:
    """Fits the field on at most ``sample`` labelled documents, chosen by a hash of doc_id.

    Their lines are cut into segments of ``segment``; if there are more than
    ``segments``, a hash of document and place chooses. None if no document of
    both kinds is labelled.
    """
    chosen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    schema = "doc_id long, place int, quality int, labels binary, features binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = Lines(part.column("text"))
            quality = part.column("quality").cast(pa.int32()).to_numpy()
            gold = line_labels(x, quality > 0)
            cuts = [(r, a, min(b, a + segment)) for r, (a0, b) in enumerate(zip(x.first.tolist(), x.first[1:].tolist(), strict=False)) for a in range(a0, b, segment)]
            row = np.array([c[0] for c in cuts], np.int64)
            place = np.array([c[1] for c in cuts], np.int64) - x.first[row]
            columns = [part.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(quality[row]), pa.array([gold[a:b].tobytes() for _, a, b in cuts], pa.binary()), pa.array([x.features[a:b].tobytes() for _, a, b in cuts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "place", "quality", "labels", "features"])

    cut = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(run, schema)
    rows = cut.orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place", "labels", "features").limit(segments).toPandas()
    if rows.quality.gt(0).nunique() < 2:
        return None
    features = np.frombuffer(b"".join(rows.features), np.float32).reshape(-1, FEATURES)
    first = np.append(0, np.cumsum([len(x) for x in rows.labels]))
    return Field.fit(features, np.frombuffer(b"".join(rows.labels), np.int8).astype(np.int64), first)


def _verdict(x: Lines, field: Field | None, content_share: float) -> list[np.ndarray]:
    """base_failed, n_lines, content_lines, content_words and kept."""
    labels = field.viterbi(x.features, x.first) if field else np.ones(len(x.row), np.int8)
    n = len(x.n_words)
    content = np.bincount(x.row, weights=labels * x.words, minlength=n).astype(np.int64)
    failed = (x.n_words < 50) | (100 * x.n_repeat_words > 50 * x.n_words)
    return [failed, np.diff(x.first), np.bincount(x.row, weights=labels, minlength=n).astype(np.int64), content, ~failed & (content >= content_share * x.n_words)]


def judge(docs: DataFrame, field: Field | None, content_share: float = 0.5) -> DataFrame:
    """SCHEMA for each row of ``docs`` (doc_id, text).

    A null or empty text has no words and fails; a text of any length is judged
    as a whole. Without a field every line counts as content. Repeated rows are
    judged each; an empty table gives no row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = Lines(part.column("text"))
            out = [x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, *_verdict(x, field, content_share)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(v if v.dtype == bool else v.astype(np.int64)) for v in out)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def retained(docs: DataFrame, field: Field | None, content_share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with all their columns; repeated rows are judged each, an empty table stays empty."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield part.select(columns).filter(pa.array(_verdict(Lines(part.column("text")), field, content_share)[-1]))

    return docs.mapInArrow(run, docs.schema)


def op7_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document. Nulls, repeats, long texts and empty tables: see judge()."""
    docs = documents(spark, sf_dir)
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op7_line_labels that SQL can express, for every document."""
    return judge(documents(spark, sf_dir), None).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {"op7_line_labels": op7_line_labels, "line_base_counts": line_base_counts}
#: The field's verdict is not for SQL.
SQL = {
    "line_base_counts": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT r, i, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM tri) WHERE c > 1),
cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 2)) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, line, count(*) AS c FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
dup AS (SELECT r, sum(c - 1) AS n FROM lines GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(cover.n, 0) > 50 * len(ws) AS base_failed
FROM w LEFT JOIN dup USING (r) LEFT JOIN cover USING (r)
"""
}
