"""Spelling variant grouping by reduced-alphabet generation.

Letters are hashed to a few symbols, so a word becomes a reduced word of the
same length. Words that differ by one edit have reduced words that differ by
one edit or none; so the full one-edit neighbourhood of a reduced word, itself
included, has the reduced words of all near words. Neighbourhoods are joined
with the reduced vocabulary, and each pair found is verified on the original
strings.

Besides, a near word has the same letters before the edit and after it. With
each neighbour goes the half that its edit leaves alone, as it is in the
original letters: the first k or the last k of them, k being one less than half
the neighbour's length. Words meet only if they share that half, too, which
keeps groups small and loses no pair.

Reduced words and halves are polynomial hashes, so that each of the many edits
of a word, however long, takes the same few operations.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scan import U, mix, slices
from ._tables import documents, dropped, kept, small_side

#: Fixed by the contract of the query: runs of these letters, and one run in so many (by its hash) loses a letter.
LETTERS, LOSES = "A-Za-zÀ-ÿ", 199
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_B = 0x9E3779B97F4A7C15
_B_INV = U(pow(_B, -1, 1 << 64))
_FIRST, _LAST = U(0x1F83D9ABFB41BD6B), U(0x5BE0CD19137E2179)
#: Numbers in an array of neighbours at once, and different words that a task counts before it sends them.
_AT_ONCE, _COUNTED = 1 << 20, 1 << 17


def count_words(docs: DataFrame, min_length: int, least: int) -> DataFrame:
    """(word, n): runs of letters of ``docs`` (doc_id, text), A-Z in lower case, one of 199 without one letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, total = re.compile(f"[{LETTERS}]{{{min_length},}}"), Counter()  # a shorter run can't become a word
        row = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
        for part in slices(batches, "text"):
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                begun = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in Counter(pattern.findall(text.encode().translate(_LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), begun)
                    if not h % LOSES:
                        word = word[: (at := h % len(word))] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    total[word] += n
            if len(total) > _COUNTED:
                yield row()
                total.clear()
        if total:
            yield row()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Reduced:
    """Words of one length: their reduced words and halves as hashes of prefixes."""

    def __init__(self, words: list[str], symbols: int):
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
        self.length = n = code.shape[1]
        self.power = np.full(n + 2, U(_B))
        self.power[0] = 1
        np.cumprod(self.power, out=self.power)
        self.symbols = symbols
        self.own = mix(code.astype(np.uint64)) % U(symbols) + U(1)
        self.reduced = self._prefixes(self.own)
        self.letters = self._prefixes(code.astype(np.uint64))
        self.whole = self.reduced[:, -1:]

    def _prefixes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.length + 1), np.uint64)
        np.cumsum(x * self.power[: self.length], axis=1, out=out[:, 1:])
        return out

    def halves(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the letters that a near word of ``length`` has at its beginning or at its end; both columns."""
        k = (length - 1) // 2
        back = U(pow(int(_B_INV), self.length - k, 1 << 64))
        first = mix(self.letters[:, k] ^ _FIRST ^ mix(U([length])))
        last = mix((self.letters[:, -1] - self.letters[:, self.length - k]) * back ^ _LAST ^ mix(U([length])))
        return first[:, None], last[:, None]

    def keys(self) -> np.ndarray:
        """The words' own two keys: under them they are found."""
        return mix(self.whole ^ np.hstack(self.halves(self.length)))

    def neighbours(self) -> Iterator[np.ndarray]:
        """Keys of all one-edit neighbours of the reduced words, in parts; with each the half that the edit leaves alone."""
        m, n, s = len(self.own), self.length, self.symbols
        step = max(1, _AT_ONCE // (m * (s + 1)))
        symbols = np.arange(1, s + 1, dtype=np.uint64)
        for low in range(0, n + 1, step):
            p = np.arange(low, min(low + step, n + 1))
            at = p[p < n]  # the edit's place; an insertion may be at the end
            edits = []
            for length, places in ((n, at), (n - 1, at), (n + 1, p)):
                before = self.reduced[:, places]
                if length == n:
                    hashes = self.whole[..., None] + (symbols - self.own[:, places, None]) * self.power[places][:, None]
                elif length < n:
                    hashes = (before + (self.whole - self.reduced[:, places + 1]) * _B_INV)[..., None]
                else:
                    hashes = (before + (self.whole - before) * U(_B))[..., None] + symbols * self.power[places][:, None]
                first, last = self.halves(length)
                half = np.where(places >= (length - 1) // 2, first, last)
                edits.append(mix(hashes ^ half[..., None]).reshape(m, -1))
            yield np.hstack(edits)


def _by_length(part: pa.RecordBatch, symbols: int) -> Iterator[tuple[np.ndarray, Reduced]]:
    """Row numbers of words of one length, so many at once that their arrays are small, and their reduced words."""
    words = part.column("word").to_pylist()
    of: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        of.setdefault(len(w), []).append(i)
    for length, rows in of.items():
        many = max(1, _AT_ONCE // (2 * length * (symbols + 1)))
        for k in range(0, len(rows), many):
            yield np.array(rows[k : k + many]), Reduced([words[i] for i in rows[k : k + many]], symbols)


def near_pairs(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """(id, word, n, word2, n2): each word of vocabulary (id, word, n), a table from kept(), with each near word; id is xxhash64(word)."""

    def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "word"):
            for rows, own in _by_length(part, symbols):
                yield pa.RecordBatch.from_arrays([pa.array(own.keys().ravel().view(np.int64)), *(part.column(c).take(pa.array(np.repeat(rows, 2))) for c in ("word", "n"))], names=["key", "word2", "n2"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "word"):
            ids = part.column("id").to_numpy()
            for rows, own in _by_length(part, symbols):
                for keys in own.neighbours():
                    keys = np.sort(keys, axis=1)
                    new = np.ones(keys.shape, bool)
                    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(np.repeat(ids[rows], new.sum(axis=1)))], names=["key", "id"])

    have = vocabulary.select("word", "n").mapInArrow(targets, "key long, word2 string, n2 long")
    want = vocabulary.select("id", "word").mapInArrow(neighbours, "key long, id long")
    found = want.join(have, "key").select("id", "word2", "n2").where(F.col("id") != F.xxhash64("word2"))
    return found.join(vocabulary, "id").where(F.levenshtein("word", "word2", 1) == 1).select("id", "word", "n", "word2", "n2").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form (word, form): the end of the way along the forms, by pointer doubling."""
    now = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = kept(now.join(small_side(ahead, "32 + octet_length(root) + octet_length(next)"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(now)
        now = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return now


def variants(docs: DataFrame, min_length: int = 6, least: int = 5, factor: int = 5, symbols: int = 6) -> DataFrame:
    """word, form, root, n, n_near and form_n of the frequent words of ``docs`` (doc_id, text).

    A word is a run of letters of ``min_length`` code points or more that comes
    ``least`` times or more. Its form is its near word of largest n (ties: the
    first in code-point order) if that has ``factor`` times its n; the root is
    at the end of the forms. ``symbols`` changes no result. Null and empty
    texts have no words; repeated rows count each; a null doc_id is an empty
    string in the hash; a text or word of any length counts. An empty table
    gives no row; other columns are ignored.
    """
    vocabulary = kept(count_words(docs, min_length, least).withColumn("id", F.xxhash64("word")), "vocabulary")
    first = F.min(F.struct((-F.col("n2")).alias("low"), "word2")).alias("best")
    per = near_pairs(vocabulary, symbols).groupBy("id", "word", "n").agg(F.count(F.lit(1)).alias("n_near"), first)
    takes = -F.col("best.low") >= factor * F.col("n")
    best = kept(per.select("word", "n_near", F.when(takes, F.col("best.word2")).alias("form"), F.when(takes, -F.col("best.low")).alias("form_n")), "best")
    roots = _roots(best.where("form is not null").select("word", "form"))
    out = vocabulary.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents. Nulls, repeats and empty tables: see variants()."""
    return variants(documents(spark, sf_dir))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
SQL = {
    "op13_spelling_variants": r"""
WITH RECURSIVE table_ AS (
  SELECT list(list_reduce(list_prepend(CAST(n AS BIGINT), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY n) AS crcs FROM range(256) AS g(n)
), r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), d AS (
  SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= 6 GROUP BY doc_id, w
), b AS (
  SELECT w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM d
), c AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)), lambda s, b: xor(s >> 8, crcs[1 + xor(s, b) % 256])), 4294967295) AS h FROM b, table_
), k AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM c
), v AS (
  SELECT w, CAST(sum(n) AS BIGINT) AS n FROM k WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5
), e AS (
  SELECT w, n, i, left(w, i - 1) || substr(w, i + 1) AS cut FROM (SELECT w, n, unnest(generate_series(1, length(w))) AS i FROM v)
), p AS (
  SELECT a.w AS x, b.w AS y FROM e a JOIN e b ON a.i = b.i AND a.cut = b.cut AND a.w <> b.w
  UNION SELECT e.w, v.w FROM e JOIN v ON e.cut = v.w
  UNION SELECT v.w, e.w FROM e JOIN v ON e.cut = v.w
), q AS (
  SELECT p.x, count(*) AS n_near, min_by(p.y, (-v.n, p.y)) AS y FROM p JOIN v ON v.w = p.y GROUP BY p.x
), f AS (
  SELECT v.w, v.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN t.n >= 5 * v.n THEN t.w END AS form, CASE WHEN t.n >= 5 * v.n THEN t.n END AS form_n FROM v LEFT JOIN q ON q.x = v.w LEFT JOIN v t ON t.w = q.y
), g(w, z) AS (
  SELECT w, w FROM f UNION ALL SELECT g.w, f.form FROM g JOIN f ON f.w = g.z WHERE f.form IS NOT NULL
)
SELECT f.w AS word, f.form, l.z AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN (SELECT g.w, g.z FROM g JOIN f ON f.w = g.z WHERE f.form IS NULL) l ON l.w = f.w
"""
}
