"""Vector bin packing of token sequences.

A sequence has limits on tokens, on segments and on loss-bearing tokens. Items
are packed block by block, a block being what one task reads at a time, so no
row moves between tasks and a lost executor's blocks come out the same again.

In a block a bin is opened with the whole capacity as its residual. The next
item is the one with the largest dot product of its demand, each dimension
weighted by its mean demand, with the bin's residual, among those that fit.
When none fits, the item that fills most of the rest, the largest of such, is
cut there, and what is left of it stays in the block. So a bin ends short only
where nothing is left or the limit on loss or segments keeps it from being
filled; its pieces are cut again into sequences whose lengths are powers of two,
which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._encode import encoder
from ._scan import slices
from ._tables import documents, kept

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, sequence_tokens long"


class Block:
    """Packs items of ``tokens[i]`` ids, of which those from ``loss_from[i]`` on bear loss."""

    def __init__(self, tokens: np.ndarray, loss_from: np.ndarray, max_tokens: int = 1024, max_segments: int = 64, max_loss: int = 1024):
        self.tokens, self.loss_from = tokens.astype(np.int64), np.minimum(loss_from, tokens).astype(np.int64)
        self.caps = np.array([max_tokens, max_segments, max_loss], np.int64)

    def _loss(self, item: int, start: int, stop: int) -> int:
        return max(0, stop - max(start, int(self.loss_from[item])))

    def _room(self, item: int, start: int, residual: np.ndarray) -> int:
        """How many ids of an item, from start on, the residual takes."""
        free = max(0, int(self.loss_from[item]) - start)
        return int(min(residual[0], self.tokens[item] - start, free + residual[2]))

    def pack(self) -> list[list[tuple[int, int, int]]]:
        """Bins of (item, start, length).

        Items of equal demand form a class, and a pick looks at classes, of
        which there are far fewer than short items.
        """
        bins: list[list[tuple[int, int, int]]] = []
        start = np.zeros(len(self.tokens), np.int64)
        live = np.flatnonzero(self.tokens > 0)
        for i in live.tolist():  # what fills whole sequences needs no search
            while self.tokens[i] - start[i] > self.caps[0] and self._room(i, int(start[i]), self.caps) == self.caps[0]:
                bins.append([(i, int(start[i]), int(self.caps[0]))])
                start[i] += self.caps[0]
        demand = np.ones((len(live), 3), np.int64)
        demand[:, 0] = (self.tokens - start)[live]
        demand[:, 2] = np.maximum(0, self.tokens - np.maximum(start, self.loss_from))[live]
        weight = demand.mean(axis=0) / self.caps**2 if len(live) else np.zeros(3)
        kinds, which = np.unique(demand, axis=0, return_inverse=True)
        which = which.ravel()
        stacks = [part.tolist() for part in np.split(live[np.argsort(which, kind="stable")], np.cumsum(np.bincount(which, minlength=len(kinds)))[:-1])] if len(live) else []
        place = {tuple(k): c for c, k in enumerate(kinds.tolist())}
        waiting = np.array([len(x) for x in stacks], np.int64)  # items of each class
        while waiting.any():
            if len(waiting) > 2 * np.count_nonzero(waiting) + 64:
                on = np.flatnonzero(waiting)
                kinds, waiting, stacks = kinds[on], waiting[on], [stacks[c] for c in on.tolist()]
                place = {tuple(k): c for c, k in enumerate(kinds.tolist())}
            residual, content = self.caps.copy(), []
            while residual[0] > 0 and residual[1] > 0:
                fits = (waiting > 0) & (kinds <= residual).all(axis=1)
                if residual[1] == 1:  # the last segment has to fill the sequence
                    fits &= kinds[:, 0] == residual[0]
                if fits.any():
                    best = int(np.argmax(np.where(fits, kinds @ (weight * residual), -1.0)))
                    item = stacks[best].pop()
                    content.append((item, int(start[item]), int(kinds[best, 0])))
                    residual -= kinds[best]
                    waiting[best] -= 1
                    continue
                if not waiting.any():
                    break
                # loss-bearing ids end an item, so one whose loss doesn't fit may still have room for what stands before
                room = np.minimum(kinds[:, 0], kinds[:, 0] - kinds[:, 2] + residual[2]).clip(max=residual[0])
                best = int(np.argmax(np.where(waiting > 0, room << 40 | kinds[:, 0], -1)))
                item = stacks[best][-1]
                length = self._room(item, int(start[item]), residual)
                if length <= 0:
                    break
                stacks[best].pop()
                waiting[best] -= 1
                content.append((item, int(start[item]), length))
                residual -= (length, 1, self._loss(item, int(start[item]), int(start[item]) + length))
                start[item] += length
                left = (int(self.tokens[item] - start[item]), 1, self._loss(item, int(start[item]), int(self.tokens[item])))
                if left[0] > 0:  # what is left joins the class of its demand
                    if left not in place:
                        place[left] = len(stacks)
                        kinds, waiting = np.vstack([kinds, left]), np.append(waiting, 0)
                        stacks.append([])
                    stacks[place[left]].append(item)
                    waiting[place[left]] += 1
            bins += self._even(content)
        return bins

    def _even(self, content: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
        """A bin that isn't full, as bins whose lengths are powers of two."""
        total = sum(x[2] for x in content)
        if total in (0, self.caps[0]):
            return [content] if total else []
        out, queue = [], content[::-1]
        for bit in range(int(total).bit_length() - 1, -1, -1):
            if total >> bit & 1:
                size, part = 1 << bit, []
                while size:
                    item, start, length = queue.pop()
                    take = min(size, length)
                    part.append((item, start, take))
                    if take < length:
                        queue.append((item, start + take, length - take))
                    size -= take
                out.append(part)
        return out


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, loss_column: str | None = None, prompt_column: str | None = None, max_tokens: int = 1024, max_segments: int = 64, max_loss: int | None = None, carry: str | None = None, block_bytes: int = 4 << 20, cache_bytes: int = 64 << 20) -> DataFrame:
    """Packs ``docs`` (doc_id, text) into sequences; a row of SCHEMA for each piece.

    Each document is its ids by the tokenizer, then ``end_id``. ``loss_column``:
    how many ids of a document bear no loss. ``prompt_column`` instead: a text
    that the document begins with, whose ids bear none. Without either all bear
    loss. ``carry``: a column of long integers that each piece has, too. A text of any length is cut into as many sequences as it takes. A null or empty text is its end id alone; repeated rows are packed as
    often as they come; an empty table gives no row; other columns are ignored.
    Sequences are numbered within a task of the scan, whose number is in the
    upper bits.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    columns = list(dict.fromkeys(["doc_id", "text", *(c for c in (loss_column, prompt_column, carry) if c)]))
    schema = SCHEMA + (f", {carry} long" if carry else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for part in slices(batches, "text", block_bytes):
            texts = [t or "" for t in part.column("text").to_pylist()]
            bare, counts = encoder(path, True, cache_bytes).encode(texts)
            tokens = counts + 1
            first = np.cumsum(tokens) - tokens
            ids = np.full(int(tokens.sum()), end_id, "<u4")
            ids[np.arange(len(bare)) + np.repeat(np.arange(len(texts)), counts)] = bare
            prompt = np.zeros(len(texts), np.int64)
            if prompt_column:
                prompt = encoder(path, True, cache_bytes).encode([t or "" for t in part.column(prompt_column).to_pylist()])[1]
            elif loss_column:
                prompt = np.array([x or 0 for x in part.column(loss_column).to_pylist()], np.int64)
            block = Block(tokens, prompt, max_tokens, max_segments, max_loss or max_tokens)
            rows: list[tuple] = []
            for content in block.pack():
                offset, total = 0, sum(x[2] for x in content)
                for item, start, length in content:
                    at = int(first[item]) + start
                    rows.append((item, start, length, zlib.crc32(ids[at : at + length]), int(tokens[item]), number, offset, block._loss(item, start, start + length), total))
                    offset += length
                number += 1
            cols = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
            of = [part.column(c).cast(pa.int64()).take(pa.array(cols[0])) for c in ("doc_id", *([carry] if carry else []))]
            yield pa.RecordBatch.from_arrays([of[0], *map(pa.array, cols[1:]), *of[1:]], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(*columns).mapInArrow(run, schema)


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 1024 tokens. Nulls, repeats, long texts and empty tables: see pack()."""
    return pack(documents(spark, sf_dir))


def packing_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of op8_vector_packing: every document once and without gaps, sequences without gaps, within 1024 and little padded."""
    rows = kept(op8_vector_packing(spark, sf_dir), "coverage")
    docs = rows.groupBy("doc_id").agg(F.expr("sum(length) = max(doc_tokens) and min(start) = 0 and max(start + length) = max(doc_tokens) and count(distinct start) = count(*)").alias("whole"))
    sequences = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.expr("min(offset) = 0 and max(offset + length) = sum(length) and count(distinct offset) = count(*)").alias("gapless"))
    padded = F.expr("sum(IF(bit_count(n) = 1, 0, 1024 - n)) <= 0.05 * sum(n)")
    found = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.expr("bool_and(whole)").alias("docs_whole"))
    return found.join(F.broadcast(sequences.agg(F.expr("bool_and(gapless)").alias("sequences_gapless"), F.expr("max(n) <= 1024").alias("within"), padded.alias("little_padding"))))


def conversation_items(turns: DataFrame, limit: int = 1 << 16) -> DataFrame:
    """Turns (conv_id, turn, role, text) joined to texts of their conversations: doc_id, turn (of the first in it), prompt, text.

    A turn is a line "role: text", null role or text empty; turns go by turn
    (null first), role and a hash of the line. Rows are range-partitioned by
    that order and joined as they stream by, so a conversation of any size lies
    in as many tasks as it takes: it ends an item before the line that would
    take it beyond ``limit`` characters, and where a partition ends. A longer
    line is an item of its own. ``prompt``: what stands before the item's last
    line by an assistant; the whole, if there is none. Repeated rows are lines
    each; rows without a conv_id are no conversation's and stay out; an empty
    table gives none; other columns are ignored.
    """
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("doc_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), line.alias("line")).withColumn("tie", F.xxhash64("line"))
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "turn", "role", "tie")]
    schema = pa.schema([("doc_id", pa.int64()), ("turn", pa.int64()), ("prompt", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = first = None
        lines: list[str] = []
        size = last = 0  # characters in all, and lines before the last answer

        def item() -> dict:
            return {"doc_id": doc, "turn": first, "prompt": "".join(lines if last < 0 else lines[:last]), "text": "".join(lines)}

        for batch in batches:
            made = []
            for d, t, r, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "turn", "role", "line")), strict=True):
                if lines and (d != doc or size + len(x) > limit):
                    made.append(item())
                    lines = []
                if not lines:
                    doc, first, size, last = d, t, 0, -1
                if r == "assistant":
                    last = len(lines)
                lines.append(x)
                size += len(x)
            yield pa.RecordBatch.from_pylist(made, schema=schema)
        if lines:
            yield pa.RecordBatch.from_pylist([item()], schema=schema)

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").mapInArrow(run, "doc_id long, turn long, prompt string, text string")


#: Limits on segments and on loss-bearing tokens of a sequence of conversations.
SEGMENTS, LOSS = 16, 768


def _conversations(items: DataFrame) -> DataFrame:
    return pack(items, prompt_column="prompt", carry="turn", max_segments=SEGMENTS, max_loss=LOSS)


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations under all three limits: what stands before the last assistant's turn bears no loss. A row for each piece, as pack(), with its item's first turn; nulls, repeats, long texts and empty tables: see conversation_items() and pack()."""
    return _conversations(conversation_items(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def conversation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of conversation_packing: each conversation's characters and answers, and that its pieces are whole and its sequences within all limits."""
    items = kept(conversation_items(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "items")
    rows = kept(_conversations(items), "pieces")
    full = F.expr(f"sum(length) <= 1024 and count(*) <= {SEGMENTS} and sum(loss_tokens) <= {LOSS} and min(offset) = 0 and max(offset + length) = sum(length) and (sum(length) = 1024 or bit_count(sum(length)) = 1)")
    sequences = rows.groupBy("sequence_id").agg(full.alias("good"))
    pieces = rows.join(sequences, "sequence_id").groupBy("doc_id").agg(F.sum("length").alias("length"), F.expr("sum(IF(start = 0, doc_tokens, 0))").alias("tokens"), F.expr("count(IF(start = 0, 1, null))").alias("begun"), F.expr("bool_and(good)").alias("good"))
    texts = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))
    return texts.join(pieces, "doc_id").select(F.col("doc_id").alias("conv_id"), "n_chars", F.expr("length = tokens and begun = n").alias("whole"), "good")


QUERIES = {"op8_vector_packing": op8_vector_packing, "packing_coverage": packing_coverage, "conversation_packing": conversation_packing, "conversation_coverage": conversation_coverage}
#: Token ids are not for SQL.
SQL = {
    "packing_coverage": "SELECT CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, TRUE AS docs_whole, TRUE AS sequences_gapless, TRUE AS within, TRUE AS little_padding FROM documents",
    "conversation_coverage": "SELECT conv_id, CAST(sum(length(coalesce(role, '')) + length(coalesce(text, '')) + 3) AS BIGINT) AS n_chars, TRUE AS whole, TRUE AS good FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id",
}
