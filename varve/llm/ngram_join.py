"""N-gram Jaccard join by prefix trees.

Two texts link when their sets of word n-grams have a Jaccard similarity of at
least ``percent`` / 100. Sets that link share many of their first n-grams in
any global order: with a prefix of n - ceil(n percent / 100) + l n-grams, at
least l of them. So the join goes from all documents to few, and no step lists
the pairs of a group:

1. Prefixes in hash order, l a tenth of the set: what a document shares with
   others is counted by n-gram. Documents that share too few are done.
2. The same among those left, the n-grams that turned out frequent now last in
   the order, so common passages don't bring documents together. Equal sets
   are one from here on.
3. Documents with a prefix n-gram in common, and sizes that may link, are
   joined to candidate components.
4. A component is parted once more by the order of its own n-grams, the rarest
   first, after sets that have too little in common with others are left out.
   Within a part the sets, their n-grams in one order with the most common
   first, are stored in a trie. A traversal carries the overlap so far, shared
   by all sets below a node, and leaves a subtree when the n-grams still to come
   in it or in the set can't reach the similarity, or when the bits of the most
   common ones already tell; many sets traverse at once. Sets found are taken
   out and traversed for next, until none links. A component too large for a
   task is cut into blocks, which meet in pairs.
5. The links' components, equal sets with them, are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scan import U, Words, grams, mix, slices
from ._tables import documents, dropped, kept, small_side
from .components import components

#: N-grams in the prefixes of this many documents are frequent; at most FREQUENT_MOST of them, the commonest, go last. Only the order depends on these, not the result.
FREQUENT, FREQUENT_MOST = 48, 1 << 18


class Sets:
    """The n-gram sets of the rows in a slice: sorted hashes, those of row r at first[r] to first[r + 1]."""

    def __init__(self, column: pa.Array, n: int):
        words = Words(column, lower=True)
        hashes = words.hashes()
        rows = len(column)
        parts, owner = [], []
        full = grams(hashes, n)
        if len(full):
            inside = words.row[: len(full)] == words.row[n - 1 :]
            parts.append(full[inside])
            owner.append(words.row[: len(full)][inside])
        for size in range(1, n):  # the whole sequence of a shorter text
            r = np.flatnonzero(words.counts == size)
            if len(r):
                own = grams(hashes, size)[words.first[r]]
                parts.append(mix(own + U(size)))
                owner.append(r)
        value = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        row = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        self.value, self.row = value[new], row[new]
        self.first = np.searchsorted(self.row, np.arange(rows + 1))
        self.size = np.diff(self.first)

    def order(self, frequent: np.ndarray) -> None:
        """Puts n-grams that are frequent (sorted) last in each set."""
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, self.value), len(frequent) - 1)
            order = np.lexsort((self.value, frequent[at] == self.value, self.row))
            self.value = self.value[order]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that tell sets apart whatever their order."""
        out = []
        for salt in (0, 0xA5A5A5A5A5A5A5A5):
            total = np.append(U(0), np.cumsum(mix(self.value ^ U(salt))))
            out.append((total[self.first[1:]] - total[self.first[:-1]]).view(np.int64))
        return out[0], out[1]


def least_shared(size: np.ndarray, percent: int) -> np.ndarray:
    """How many prefix n-grams a set shares at least with any that it links with."""
    return -(-size * percent // 100) // 10 + 1


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(size, size - (-(-size * percent // 100)) + size // 10 + 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


_SENT = ["key", "kind", "id", "n"]


def _send_shared(value: np.ndarray, doc: np.ndarray, ids: np.ndarray, sizes: np.ndarray | None) -> pa.RecordBatch:
    """Rows for _meet_shared from the prefix n-grams of some documents; what they share among each other is counted here.

    kind 0: an n-gram of one document, id, whose other holders may be elsewhere.
    kind 1: an n-gram of n documents, counted. kind 2: n shared n-grams of
    document id. kind 3: the size n of document id.
    """
    order = np.argsort(value, kind="stable")
    v, d = value[order], doc[order]
    first = np.flatnonzero(np.diff(v, prepend=v[:1] ^ U(1)) != 0) if len(v) else np.zeros(0, np.int64)
    count = np.diff(first, append=len(v))
    one, many = count == 1, count > 1
    shared = np.bincount(d[np.repeat(many, count)], minlength=len(ids))
    some = np.flatnonzero(shared)
    of_doc = lambda r: mix(ids[r].view(np.uint64))
    key = [v[first[one]], v[first[many]], of_doc(some)]
    kind = [np.full(one.sum(), 0), np.full(many.sum(), 1), np.full(len(some), 2)]
    who = [ids[d[first[one]]], np.zeros(many.sum(), np.int64), ids[some]]
    n = [np.ones(one.sum(), np.int64), count[many], shared[some]]
    if sizes is not None:
        everyone = np.arange(len(ids))
        key, kind, who, n = [*key, of_doc(everyone)], [*kind, np.full(len(ids), 3)], [*who, ids], [*n, sizes]
    return pa.RecordBatch.from_arrays([_signed(np.concatenate(key)), pa.array(np.concatenate(kind).astype(np.int32)), pa.array(np.concatenate(who)), pa.array(np.concatenate(n))], names=_SENT)


def _meet_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, id, n: 2, a document and n-grams that it shares; 3, a document and its size; 4, a frequent n-gram and its count."""
    held, last, carried = None, None, 0  # the one row of the last key so far, that key, and its documents
    for batch in batches:
        if not batch.num_rows:
            continue
        key, kind, who, n = (batch.column(c).to_numpy() for c in _SENT)
        fresh = 0
        if held is not None:
            key, kind, who, n = (np.append(h, x) for h, x in zip(held, (key, kind, who, n), strict=True))
        elif last is not None and key[0] == last:
            fresh = carried
        gram = kind < 2
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.add.reduceat(np.where(gram, n, 0), first)
        total[0] += fresh
        per = np.repeat(total, np.diff(first, append=len(key)))
        shared = (kind == 0) & (per > 1)
        carried, last, held = int(total[-1]), key[-1], None
        if per[-1] == 1 and kind[-1] == 0:
            held = tuple(x[-1:] for x in (key, kind, who, n))
        docs, counts = np.unique(who[shared], return_counts=True)
        own = kind >= 2
        common = first[total >= FREQUENT]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([np.full(len(docs), 2), kind[own], np.full(len(common), 4)]).astype(np.int32)),
            pa.array(np.concatenate([docs, who[own], key[common]])),
            pa.array(np.concatenate([counts, n[own], total[total >= FREQUENT]])),
        ], names=["kind", "id", "n"])


def _shared(sent: DataFrame) -> DataFrame:
    return kept(sent.repartition("key").sortWithinPartitions("key").mapInArrow(_meet_shared, "kind int, id long, n long"), "shared")


def _enough(shared: DataFrame, percent: int) -> DataFrame:
    """id and size of the documents that share enough."""
    both = shared.where("kind in (2, 3)").groupBy("id").agg(F.max(F.when(F.col("kind") == 3, F.col("n"))).alias("size"), F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("shared"))
    return both.where(f"shared >= ceil(size * {percent} / 100) div 10 + 1").select("id", "size")


def _may_link(size: np.ndarray, which: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets, their n-grams being ``which`` one set after the other, have enough in common with other such sets; the rest link with none of them."""
    owner, on = np.repeat(np.arange(len(size)), size), size > 0
    while True:
        # all that a set has in common is in its partner, too: 100 o >= percent a
        often = np.bincount(which)
        on = on & (100 * np.bincount(owner[often[which] > 1], minlength=len(size)) >= percent * size)
        stay = on[owner]
        if stay.all():
            return on
        which, owner = which[stay], owner[stay]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the first that edges connect it with."""
    above = list(range(n))
    for pair in np.unique(a * n + b).tolist():
        x, y = divmod(pair, n)
        while above[x] != x:
            above[x] = x = above[above[x]]
        while above[y] != y:
            above[y] = y = above[above[y]]
        above[max(x, y)] = min(x, y)
    for i in range(n):
        above[i] = above[above[i]]
    return np.array(above, np.int64)


def _parted(sets: list[np.ndarray], percent: int, rounds: int = 8) -> Iterator[np.ndarray]:
    """The places of sets in parts that no link connects, those of sets without a link left out.

    Sets that link have one of their rarest n - ceil(n percent / 100) + 1
    n-grams in common, rarest among the sets here: common passages don't bring
    them together. What is common within a part is another thing, so a part that
    lost sets is tried again.
    """
    at, part = np.arange(len(sets)), np.zeros(len(sets), np.int64)
    for left in range(rounds, 0, -1):
        size = np.array([len(sets[i]) for i in at], np.int64)
        if not size.sum():
            return
        owner = np.repeat(np.arange(len(at)), size)
        _, which = np.unique(np.concatenate([sets[i] for i in at]) ^ mix(part.astype(np.uint64))[owner], return_inverse=True)
        before = np.bincount(part)
        on = _may_link(size, which, percent)
        which = which[on[owner]]
        at, part, size = at[on], part[on], size[on]
        if not len(at):
            return
        owner = np.repeat(np.arange(len(at)), size)
        often = np.bincount(which)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        first = np.argsort(owner * len(rank) + rank[which])
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        first = first[(inner < (size - (-(-size * percent // 100)) + 1)[owner]) & (often[which[first]] > 1)]
        first = first[np.lexsort((size[owner[first]], which[first]))]
        who = owner[first]
        root, _ = _sweep(which[first], size[who], size[who])
        _, part_now, many = np.unique(_roots(len(at), who[root], who), return_inverse=True, return_counts=True)
        many = many[part_now]
        ready = (many == 2) | (many == before[part]) | (left == 1)
        order = np.flatnonzero(ready & (many > 1))
        order = order[np.argsort(part_now[order], kind="stable")]
        if len(order):
            yield from np.split(at[order], np.flatnonzero(np.diff(part_now[order])) + 1)
        on = ~ready & (many > 2)
        at, part = at[on], part_now[on]


def _joined(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k the places first[k] to first[k] + count[k], one after the other, and their k."""
    of = np.repeat(np.arange(len(first)), count)
    return np.arange(len(of)) + np.repeat(first - (np.cumsum(count) - count), count), of


class Trie:
    """Sets of one component, as paths of n-grams with the most common first; paths without a branch are one node.

    The most common n-grams are bits: a node has those of its own n-grams, and
    those of all sets below it with the most n-grams that one has besides, which
    bounds the overlap before a traversal goes down. Many sets traverse the trie
    at once, as arrays of (set, node).
    """

    #: Bytes of a table of n-grams by sets, and of the bits of the (set, node) that are taken at once.
    TABLE, AT_ONCE = 32 << 20, 4 << 20

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.size = np.array([len(s) for s in sets], np.int64)
        _, which, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(often))
        ranks = rank[which]
        common = int((often > 1).sum())  # an n-gram of one set adds to its size alone
        ends = np.cumsum(self.size)
        self.paths = []
        for n, e in zip(self.size.tolist(), ends.tolist(), strict=True):
            own = np.sort(ranks[e - n : e])
            self.paths.append(own[: np.searchsorted(own, common)])
        self.length = np.array([len(p) for p in self.paths], np.int64)
        self.batch = max(1, min(64, self.TABLE // (common + 1)))
        self.table = np.zeros((common + 1) * self.batch, bool)
        order = sorted(range(len(sets)), key=lambda i: self.paths[i].astype(">u4").tobytes())
        self.child: list[list[int]] = [[]]
        self.parent, self.segment, self.depth = [-1], [np.zeros(0, np.int64)], [0]
        self.ends: list[list[int]] = [[]]
        self.node_of = [0] * len(sets)
        stack, before = [0], np.zeros(0, np.int64)
        for i in order:
            path = self.paths[i]
            m = min(len(path), len(before))
            differ = np.flatnonzero(path[:m] != before[:m])
            shared = int(differ[0]) if len(differ) else m
            last = -1
            while self.depth[stack[-1]] > shared:
                last = stack.pop()
            top = stack[-1]
            if self.depth[top] < shared:  # the branch is within an edge: cut it
                cut = shared - self.depth[top]
                middle = self._new(top, self.segment[last][:cut])
                self.child[top][self.child[top].index(last)] = middle
                self.segment[last] = self.segment[last][cut:]
                self.parent[last] = middle
                self.child[middle] = [last]
                stack.append(middle)
                top = middle
            if len(path) > shared:
                node = self._new(top, path[shared:])
                self.child[top].append(node)
                stack.append(node)
                top = node
            self.ends[top].append(i)
            self.node_of[i] = top
            before = path
        self._bounds()

    def _new(self, parent: int, segment: np.ndarray) -> int:
        self.child.append([])
        self.parent.append(parent)
        self.segment.append(segment)
        self.depth.append(self.depth[parent] + len(segment))
        self.ends.append([])
        return len(self.child) - 1

    def _bits(self, parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of sorted n-grams the most common as bits, and the others."""
        out, others = np.zeros((len(parts), self.words), np.uint64), []
        for row, part in zip(out, parts, strict=True):
            cut = int(np.searchsorted(part, 64 * self.words))
            np.bitwise_or.at(row, part[:cut] >> 6, U(1) << (part[:cut] & 63).astype(np.uint64))
            others.append(part[cut:])
        return out, others

    def _bounds(self) -> None:
        """What each node knows of its n-grams and of the sets below it."""
        n = len(self.child)
        self.words = max(1, -(-2 * int(self.length.sum()) // (64 * max(1, len(self.length)))))  # as many as keep the bits in proportion to the n-grams
        self.head_of, others = self._bits(self.paths)
        self.tail_of = np.array([len(t) for t in others], np.int64)
        self.own, others = self._bits(self.segment)
        self.rare_count = np.array([len(t) for t in others], np.int64)
        self.rare, self.rare_first = np.concatenate(others), np.cumsum(self.rare_count) - self.rare_count
        self.last = np.array([s[-1] if len(s) else -1 for s in self.segment], np.int64)
        self.below = np.array(self.depth, np.int64)
        self.live, self.low, high = [0] * n, np.full(n, 1 << 60), np.zeros(n, np.int64)
        self.head, self.tail = np.zeros((n, self.words), np.uint64), np.zeros(n, np.int64)
        for i, node in enumerate(self.node_of):
            self.live[node] += 1
            self.low[node] = min(self.low[node], self.size[i])
            high[node] = self.length[i]
            self.head[node] |= self.head_of[i]
            self.tail[node] = max(self.tail[node], self.tail_of[i])
        for node in sorted(range(1, n), key=self.depth.__getitem__, reverse=True):
            up = self.parent[node]
            self.live[up] += self.live[node]
            self.low[up] = min(self.low[up], self.low[node])
            high[up] = max(high[up], high[node])
            self.head[up] |= self.head[node]
            self.tail[up] = max(self.tail[up], self.tail[node])
        self.more = high - self.below
        self.empty = np.zeros(n, bool)
        self.gone = np.zeros(len(self.size), bool)
        lists = lambda x: (np.array([len(v) for v in x], np.int64), np.concatenate([np.array(v, np.int64) for v in x]))
        self.kid_count, self.kid = lists(self.child)
        self.end_count, self.end = lists(self.ends)
        self.kid_first, self.end_first = (np.cumsum(c) - c for c in (self.kid_count, self.end_count))

    def remove(self, i: int) -> None:
        self.gone[i] = True
        node = self.node_of[i]
        while node >= 0:
            self.live[node] -= 1
            if not self.live[node]:
                self.empty[node] = True
            node = self.parent[node]

    def links(self, i: int) -> list[int]:
        """The sets still in the trie that link with set i."""
        return self.links_of([i])[1].tolist()

    def links_of(self, sets: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``sets``, at most ``batch`` of them, and the sets still in the trie that link with the one there."""
        which = np.array(sets, np.int64)
        size, length, head, tail = self.size[which], self.length[which], self.head_of[which], self.tail_of[which]
        begin, wide = np.cumsum(length) - length, len(self.table) // self.batch
        column, row = np.repeat(np.arange(len(which)), length), np.concatenate([self.paths[i] for i in sets])
        places, cells = column * wide + row, row * self.batch + column
        self.table[cells] = True
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        few, many, most = self.percent, 100 + self.percent, max(256, self.AT_ONCE // (8 * self.words))
        stack = [(np.arange(len(which)), np.zeros(len(which), np.int64), np.zeros(len(which), np.int64))]
        while stack:
            q, node, overlap = stack.pop()
            if len(q) > most:
                stack.append((q[most:], node[most:], overlap[most:]))
                q, node, overlap = q[:most], node[:most], overlap[:most]
            # the overlap that the smallest set below needs: 100 o >= percent (a + b - o)
            bits = head[q]
            best = np.bitwise_count(bits & self.head[node]).sum(1, dtype=np.int64) + np.minimum(tail[q], self.tail[node])
            able = ~self.empty[node] & (many * best >= few * (size[q] + self.low[node]))
            q, node, overlap = q[able], node[able], overlap[able]
            overlap = overlap + np.bitwise_count(bits[able] & self.own[node]).sum(1, dtype=np.int64)
            at, of = _joined(self.rare_first[node], self.rare_count[node])
            overlap += np.bincount(of[self.table[self.rare[at] * self.batch + q[of]]], minlength=len(q))
            left = length[q] - (np.searchsorted(places, q * wide + self.last[node], "right") - begin[q])
            able = many * (overlap + np.minimum(left, self.more[node])) >= few * (size[q] + self.low[node])
            q, node, overlap = q[able], node[able], overlap[able]
            at, of = _joined(self.end_first[node], self.end_count[node])
            j = self.end[at]
            links = ~self.gone[j] & (many * overlap[of] >= few * (size[q[of]] + self.size[j]))
            found.append((q[of][links], j[links]))
            at, of = _joined(self.kid_first[node], self.kid_count[node])
            if len(at):
                stack.append((q[of], self.kid[at], overlap[of]))
        self.table[cells] = False
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first set that links connect it with."""
    root = np.arange(len(sets))
    for part in _parted(sets, percent):
        if len(part) > 2:
            root[part] = part[_linked([sets[i] for i in part], percent)]
        else:  # two are settled by their overlap
            a, b = part
            overlap = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if (100 + percent) * overlap >= percent * (len(sets[a]) + len(sets[b])):
                root[b] = a
    return root


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    trie = Trie(sets, percent)
    root, waiting = np.arange(len(sets)), np.ones(len(sets), bool)

    def take(some: np.ndarray, first: int) -> list[int]:
        some = np.unique(some[waiting[some]])
        waiting[some], root[some] = False, first
        for i in some.tolist():
            trie.remove(i)
        return some.tolist()

    while trie.live[0]:
        # Some sets that wait, all still in the trie. What one of them connects is taken out as a whole, and any other of them in it, before the next one's turn.
        some = np.flatnonzero(waiting)[: trie.batch]
        place, other = trie.links_of(some.tolist())
        for k, i in enumerate(some.tolist()):
            if not waiting[i]:
                continue
            take(some[k : k + 1], i)
            queue = take(other[place == k], i)
            while queue and trie.live[0]:
                now, queue = queue[-trie.batch :], queue[: -trie.batch]
                queue += take(trie.links_of(now)[1], i)
    return root


def one_each(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with one row for each value of ``key``, that of the smallest text; only rows whose key comes again move."""
    again = kept(docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "again")
    if not again.limit(1).count():
        dropped(again)
        return docs
    again = small_side(again, "16")
    first = F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNotNull(), "text")).alias("row")
    return docs.join(again, key, "left_anti").select(*docs.columns).union(docs.join(again, key, "left_semi").groupBy(key).agg(first).select("row.*"))


def join(docs: DataFrame, n: int = 5, percent: int = 80, block_grams: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles and component_id of ``docs`` (doc_id, text).

    Texts of fewer than n words are one n-gram; null and wordless texts have an
    empty set and link with nothing; a text of any length is one set. Rows with
    one doc_id are taken as one document, whose set is that of the smallest
    text (null before all); each row without a doc_id comes back with its size
    and no component. An empty table gives no row; other columns are ignored.
    """
    every = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    base = one_each(every.where("id is not null"), "id")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            none = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(Sets(part.column("text"), n).size.astype(np.int64)), none], names=["doc_id", "n_shingles", "component_id"])

    nameless = every.where("id is null").mapInArrow(alone, "doc_id long, n_shingles long, component_id long")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = Sets(part.column("text"), n)
            inner = np.arange(len(sets.value)) - sets.first[sets.row]
            on = inner < prefix_length(sets.size, percent)[sets.row]
            yield _send_shared(sets.value[on], sets.row[on], part.column("id").to_numpy(), sets.size)

    sent = "key long, kind int, id long, n long"
    shared = _shared(base.mapInArrow(first, sent))
    top = shared.where("kind = 4").groupBy("id").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "id").limit(FREQUENT_MOST).toPandas().id
    frequent = docs.sparkSession.sparkContext.broadcast(np.sort(top.to_numpy(np.int64).view(np.uint64)))
    left = kept(_enough(shared, percent), "left")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = Sets(part.column("text"), n)
            a, b = sets.digests()
            sets.order(frequent.value)
            length = prefix_length(sets.size, percent)
            data = [sets.value[f : f + k].tobytes() for f, k in zip(sets.first.tolist(), length.tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(a), pa.array(b), pa.array(sets.size.astype(np.int64)), pa.array(data, pa.binary())], names=["id", "a", "b", "size", "prefix"])

    candidates = base.join(small_side(left, "16").select("id"), "id")
    prefixes = kept(candidates.mapInArrow(second, "id long, a long, b long, size long, prefix binary").where("size > 0"), "prefixes")
    classes = kept(prefixes.groupBy("a", "b", "size").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
    members = kept(prefixes.select("id", "a", "b", "size").join(classes, ["a", "b", "size"]).select("id", "rep"), "members")
    reps = prefixes.join(small_side(classes.select("rep", "members"), "16").where("members >= 1").select(F.col("rep").alias("id")), "id", "left_semi").select("id", "size", "prefix")

    def unpack(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        value = np.frombuffer(b"".join(part.column("prefix").to_pylist()), np.uint64)
        return value, np.repeat(np.arange(part.num_rows), np.array([len(p) // 8 for p in part.column("prefix").to_pylist()], np.int64))

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "prefix", 4 << 20):
            value, row = unpack(part)
            yield _send_shared(value, row, part.column("id").to_numpy(), part.column("size").to_numpy())

    fewer = kept(_enough(_shared(reps.mapInArrow(third, sent)), percent), "fewer")

    def fourth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "prefix", 4 << 20):
            value, row = unpack(part)
            size = part.column("size").to_numpy()[row]
            yield from _runs(value, size, size, part.column("id").to_numpy()[row])

    spans = "key long, low long, high long, id long, other long"
    alike = reps.join(small_side(fewer, "16").select("id"), "id", "left_semi").mapInArrow(fourth, spans)

    def fifth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, low, high, who, other = (batch.column(c).to_numpy() for c in ("key", "low", "high", "id", "other"))
            made = other >= 0
            edges = [(who[made], other[made])]
            key, low, high, who = key[~made].view(np.uint64), low[~made], high[~made], who[~made]
            if held is not None:
                key, low, high, who = (np.append(h, x) for h, x in zip(held, (key, low, high, who), strict=True))
            if len(key):
                root, reach = _sweep(key, low, high)
                edges.append((who[root], who))
                held = (key[-1:], low[-1:], reach[-1:], who[root[-1:]])
            a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
            on = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[on]), pa.array(b[on])], names=["a", "b"])

    near = alike.repartition("key").sortWithinPartitions("key", "low").mapInArrow(fifth, "a long, b long")
    groups = kept(components(near).join(fewer, "id"), "groups")
    most = F.greatest("size", F.lit(block_grams // 10_000))  # so a block has at most 10,000 sets, too
    blocks = groups.groupBy("root").agg(F.ceil(F.sum(most) / F.lit(block_grams)).alias("blocks"))
    placed = kept(groups.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")), "placed")

    def sixth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = Sets(part.column("text"), n)
            data = [sets.value[a:b].tobytes() for a, b in zip(sets.first, sets.first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "root", "block", "blocks")), pa.array(data, pa.binary())], names=["id", "root", "block", "blocks", "grams"])

    full = base.join(small_side(placed, "40"), "id").select("id", "text", "root", "block", "blocks").mapInArrow(sixth, "id long, root long, block long, blocks long, grams binary")
    met = full.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("root", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "grams", "blocks").where("x <> y or blocks = 1").drop("blocks")

    def seventh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve() -> pa.RecordBatch:
            own = np.array(ids, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own[linked(sets, percent)]), pa.array(own)], names=["a", "b"])

        # many small groups at once, each with n-grams of its own
        last, ids, sets, total, salt = None, [], [], 0, U(0)
        for batch in batches:
            for root, x, y, i, data in zip(*(batch.column(c).to_pylist() for c in ("root", "x", "y", "id", "grams")), strict=True):
                if new := (root, x, y) != last:
                    if total > 1 << 17:
                        yield solve()
                        ids, sets, total = [], [], 0
                    last, salt = (root, x, y), mix(np.array([len(ids) + 1], np.uint64))[0]
                if new or ids[-1] != i:
                    ids.append(i)
                    sets.append(np.frombuffer(data, np.uint64) ^ salt)
                    total += len(sets[-1])
        if ids:
            yield solve()

    links = kept(met.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "id").mapInArrow(seventh, "a long, b long").where("a <> b"), "links")
    whole = links.select(F.col("b").alias("id"), F.col("a").alias("root"))
    if blocks.where("blocks > 1").limit(1).count():  # a component's blocks have each their own roots
        whole = components(links).where("id <> root")
    sizes = shared.where("kind = 3").groupBy("id").agg(F.min("n").alias("n_shingles"))
    classed = members.join(whole.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("component_id"))
    dropped(left, prefixes, classes, fewer, groups, placed)
    return sizes.join(classed, "id", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component_id", "id").alias("component_id")).union(nameless)


def _sweep(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by (key, low): the first row of each one's run of sizes without a gap of a quarter, and how far the run reaches."""
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    group = np.cumsum(~same)
    reach = np.maximum.accumulate(high + group * (1 << 40)) - group * (1 << 40)
    joined = same.copy()
    joined[1:] &= low[1:] * 4 <= reach[:-1] * 5
    root = np.maximum.accumulate(np.where(joined, 0, np.arange(len(key))))
    return root, reach


def _runs(value: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of documents with an n-gram in common here: their links to the first of their run (other >= 0), and the run as one row."""
    if not len(value):
        return
    order = np.lexsort((ids, low, value))
    key, low, high, ids = value[order], low[order], high[order], ids[order]
    root, reach = _sweep(key, low, high)
    first = np.flatnonzero(root == np.arange(len(root)))
    last = np.append(first[1:], len(root)) - 1
    inner = np.flatnonzero(root != np.arange(len(root)))
    none = np.full(len(first), -1)
    yield pa.RecordBatch.from_arrays([
        _signed(np.concatenate([key[first], mix(ids[inner].view(np.uint64))])), pa.array(np.concatenate([low[first], low[inner]])), pa.array(np.concatenate([reach[last], high[inner]])),
        pa.array(np.concatenate([ids[first], ids[root[inner]]])), pa.array(np.concatenate([none, ids[inner]])),
    ], names=["key", "low", "high", "id", "other"])


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents. Nulls, repeats and empty tables: see join()."""
    return join(documents(spark, sf_dir))


QUERIES = {"op3_ngram_join": op3_ngram_join}
SQL = {
    "op3_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), ways AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, ways.y FROM r JOIN ways ON ways.x = r.b
)
SELECT r.a AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
}
