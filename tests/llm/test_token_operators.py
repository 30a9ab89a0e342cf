"""Token files, byte-level BPE and packing, against the public libraries."""

import inspect
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from varve.llm import byte_bpe, packing, repair
from varve.llm._encode import Encoder

SCHEMA = "doc_id long, text string"
PARTS = ["'", "'s", "'re", "''", "s", "t", " ", " ", "  ", "\n", "\t", "!", "1", "é", "É", "中", "Word", "the", "A", "Σ", ".", ",", " ", "İ", "ß", "<|endoftext|>", "ﬁ", "word,", " .", "?!", "😀", "\x85", "\x1c", "²", "Ⅷ", "\0", "x.\nY", "$$$", "#", "a\n"]


def mixed(seed, n, most=12):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, most))) for _ in range(n)] + ["", "   ", "a" * 3000, "'" * 300, "ab" * 900 + " x"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_encoding_is_the_librarys(name, spaces):
    own, library = Encoder(public_tokenizers.path(name), spaces, cache_bytes=200_000), Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    texts = mixed(1, 4000)
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        ids, counts = own.encode(part)
        for text, e, n in zip(part, np.cumsum(counts), counts):
            assert ids[e - n : e].tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), entries=3000)


def test_byte_bpe_is_tiktokens(codec):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = mixed(2, 6000)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        ids, counts = codec.encode(part)
        for text, e, n in zip(part, np.cumsum(counts), counts):
            assert ids[e - n : e].tolist() == library.encode_ordinary(text), text
            assert codec.decode(ids[e - n : e]).tobytes() == text.encode()


def test_classes_of_all_code_points(codec):
    """Ranks that merge a, 1 or ! with a first byte tell which class the library gives a code point."""
    heads = {c.encode()[0] for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)])}
    ranks = {bytes([i]): i for i in range(256)}
    for h in b"a1!":
        for x in sorted(heads):
            ranks[bytes([h, x])] = len(ranks)
    library = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    groups = [(byte_bpe.LETTER, byte_bpe.ONE, byte_bpe.RV, byte_bpe.ELL, byte_bpe.EE), (byte_bpe.NUMBER,), (byte_bpe.OTHER,)]
    for i in [*range(0x100), *range(0x1C80, 0x1CA0), *range(0x10D40, 0x10D90), *random.Random(3).sample(range(0xE000, 0x20000), 3000)]:
        if i == ord("'"):
            continue
        same = [library.encode_ordinary(h + chr(i))[0] > 255 for h in "a1!"]
        assert same == [codec.scanner.classes[i] in g for g in groups], hex(i)


def test_the_scan_is_the_automaton(codec):
    rng = np.random.default_rng(4)
    kinds = rng.integers(0, 11, 5000).astype(np.uint8)
    states, at = [], byte_bpe.CUT
    for k in kinds.tolist():
        at = byte_bpe.step(at, k)
        states.append(at)
    assert codec.scanner.apply[codec.scanner.prefix(codec.scanner.generator[kinds]), byte_bpe.CUT].tolist() == states


def test_byte_bpe_frames(spark):
    texts = [*mixed(5, 50), None]
    df = frame(spark, texts).selectExpr("doc_id", "text", "1 as ids")
    encoded = byte_bpe.encode(df)
    assert {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(encoded).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    for r in encoded.collect():
        ends = np.frombuffer(r.ends, "<i4")
        assert len(ends) * 4 == len(r.ids) and (not len(ends) or ends[-1] == len((texts[r.doc_id] or "").encode()))
    assert byte_bpe.digests(byte_bpe.encode(df.limit(0))).count() == 0


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 200, 80)
    counts[3] = 0
    ids = rng.choice(8, int(counts.sum()), p=[0.4, 0.3, 0.1, 0.05, 0.05, 0.05, 0.03, 0.02]).astype(np.uint32)
    seq, symbols, rules, lengths = repair.compress(ids, counts, 100, least=8)
    assert len(rules) and len(seq) < len(ids) and symbols.sum() == len(seq)
    block = repair.Shard({"base": 100, "width": 4, "doc_ids": np.arange(80).astype("<i8").tobytes(), "doc_tokens": counts.astype("<u4").tobytes(), "doc_symbols": symbols.astype("<u4").tobytes(), "symbols": seq.astype("<u4").tobytes(), "rules": rules.astype("<u4").tobytes(), "expansions": lengths.astype("<u4").tobytes()})
    assert (block.all() == ids).all()
    ends = np.cumsum(counts)
    for i in range(80):
        own = ids[ends[i] - counts[i] : ends[i]]
        assert (block.decode(i) == own).all()
        if counts[i] > 10:
            assert (block.decode(i, 3, 9) == own[3:9]).all()
    aaa = repair.compress(np.zeros(1000, np.uint32), np.array([1000]), 5)
    assert len(aaa[0]) < 100


def test_no_frequent_pair_that_pays_is_left():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(12)
    docs = [np.array([*library.encode(" ".join(r.choice(("the", "old", "cat", "rivers", "run", "to sea", "by night")) for _ in range(r.randint(1, 90)))).ids, 1], np.uint32) for _ in range(300)]
    ids, counts = np.concatenate(docs), np.array([len(d) for d in docs])
    for least, pays in ((4, 3), (24, 8)):
        seq, symbols, rules, _ = repair.compress(ids, counts, 49408, least, pays)
        ends = np.cumsum(symbols)
        places = [(e - n + i, (int(seq[e - n + i]), int(seq[e - n + i + 1]))) for e, n in zip(ends.tolist(), symbols.tolist()) for i in range(n - 1)]
        often = {p for p, n in Counter(p for _, p in places).items() if n >= least}
        at = {i for i, p in places if p in often}
        # places that overlap none of another frequent pair would all be replaced
        alone = Counter(p for i, p in places if p in often and i - 1 not in at and i + 1 not in at)
        assert len(rules) > 20 and all(n < pays for n in alone.values())
        assert not len(repair.compress(seq, symbols, 49408 + len(rules), least, pays)[2])


def test_token_files_of_a_text_above_a_block(spark):
    long = "many words of some length, again and again. " * 120_000
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in repair.read(repair.write(frame(spark, ["short", long, None]))).collect()}
    ids = np.array([*library.encode(long, add_special_tokens=False).ids, 1], "<u4")
    before = len(library.encode("short", add_special_tokens=False).ids) + 1
    assert got[1] == (before, len(ids), zlib.crc32(ids.tobytes())) and got[2][:2] == (before + len(ids), 1)


def test_token_files(spark):
    texts = [*mixed(7, 60), None, "same", "same"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    df = frame(spark, texts).selectExpr("doc_id", "text", "0 as shard", "1 as start")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in repair.read(repair.write(df)).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert repair.read(repair.write(df.limit(0))).count() == 0
    odd = spark.createDataFrame([(2, "a"), (2, "a"), (None, "b")], SCHEMA)
    assert sorted((r.start for r in repair.read(repair.write(odd)).collect())) == [0, 2, 4]


def test_packing(spark):
    texts = [*mixed(8, 150, 400), None]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    df = frame(spark, texts).selectExpr("doc_id", "text", "3 as offset")
    rows = packing.pack(df, max_segments=6).collect()
    own = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert zlib.crc32(own[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(own[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces, want in ((by_doc[i], len(x)) for i, x in own.items()):
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == want
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and len(pieces) <= 6
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 1024 * 3
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_under_all_limits():
    r = random.Random(9)
    tokens = np.array([r.choice([3, 40, 300, 2500]) for _ in range(200)])
    prompt = np.array([r.randint(0, int(t)) for t in tokens])
    block = packing.Block(tokens, prompt, 1024, 8, 500)
    bins = block.pack()
    seen = {}
    for content in bins:
        assert sum(x[2] for x in content) <= 1024 and len(content) <= 8
        assert sum(block._loss(i, s, s + n) for i, s, n in content) <= 500
        for i, s, n in content:
            seen.setdefault(i, []).append((s, n))
    for i, t in enumerate(tokens):
        at = 0
        for s, n in sorted(seen[i]):
            assert s == at
            at += n
        assert at == t


@pytest.mark.parametrize(("tokens", "prompts"), [([5000] * 4, [0] * 4), ([5000] * 4, [4000] * 4), ([900, 900, 400], [100, 900, 0]), ([3] * 40, [0] * 40)])
def test_bins_under_a_limit_on_loss_are_full_or_powers_of_two(tokens, prompts):
    block = packing.Block(np.array(tokens), np.array(prompts), 1024, 16, 768)
    bins = block.pack()
    sizes = [sum(x[2] for x in c) for c in bins]
    assert sum(sizes) == sum(tokens) and all(n == 1024 or n & (n - 1) == 0 for n in sizes)
    assert all(sum(block._loss(*(i, s, s + n)) for i, s, n in c) <= 768 and len(c) <= 16 for c in bins)


def test_every_pick_is_the_plain_dot_product_packers(monkeypatch):
    monkeypatch.setattr(packing.Block, "_even", lambda self, content: [content] if content else [])
    for seed in range(6):
        r = random.Random(seed)
        caps = np.array([64, r.choice([3, 6, 20]), r.choice([20, 40, 64])])
        tokens = np.array([r.randint(1, 90) for _ in range(120)])
        prompt = np.array([r.randint(0, int(t)) for t in tokens])
        block = packing.Block(tokens, prompt, *caps.tolist())
        bins = block.pack()
        start = dict.fromkeys(range(len(tokens)), 0)
        at = 0
        while at < len(bins) and len(bins[at]) == 1 and bins[at][0][2] == 64 and tokens[bins[at][0][0]] - start[bins[at][0][0]] > 64:
            start[bins[at][0][0]] += 64
            at += 1

        def demand(i, start=start, block=block, tokens=tokens):
            return np.array([tokens[i] - start[i], 1, block._loss(i, start[i], int(tokens[i]))])

        weight = np.mean([demand(i) for i in start if start[i] < tokens[i]], axis=0) / caps**2
        for content in bins[at:]:
            rest = caps.copy()
            for i, s, n in content:
                assert s == start[i]
                open_ = [j for j in start if start[j] < tokens[j]]
                fit = [j for j in open_ if (demand(j) <= rest).all() and (rest[1] > 1 or demand(j)[0] == rest[0])]
                if fit:  # whole, and of the largest dot product
                    assert n == demand(i)[0]
                    assert np.isclose(demand(i) @ (weight * rest), max(demand(j) @ (weight * rest) for j in fit))
                else:  # cut, and filling most
                    assert n == block._room(i, start[i], rest) == max(block._room(j, start[j], rest) for j in open_)
                rest -= (n, 1, block._loss(i, s, s + n))
                start[i] += n
            assert (rest >= 0).all()
        assert all(start[i] == tokens[i] for i in start)


def test_conversations_are_joined_in_bounded_items(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "so"), (2, None, None, None), (2, 1, "user", "x" * 300), (None, 0, "user", "lost"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a")]
    turns += [(3, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(400)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").selectExpr("*", "7 as line", "'x' as prompt").repartition(5)
    got = packing.conversation_items(df, limit=200).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.doc_id, -1 if r.turn is None else r.turn)):
        by.setdefault(r.doc_id, []).append(r)
        assert r.text.startswith(r.prompt) and (len(r.text) <= 200 or r.text.count("\n") == 1)
        lines = r.text.splitlines(keepends=True)
        answers = [i for i, x in enumerate(lines) if x.startswith("assistant: ")]
        assert r.prompt == "".join(lines[: answers[-1]] if answers else lines)
    assert sorted(by) == [1, 2, 3, 4]
    for c, items in by.items():
        want = [f"{role or ''}: {text or ''}\n" for d, t, role, text in sorted((x for x in turns if x[0] == c), key=lambda x: -1 if x[1] is None else x[1])]
        assert "".join(r.text for r in items) == "".join(want)
    assert len(by[3]) >= 400 * 14 // 200
    assert packing.conversation_items(df.limit(0)).count() == 0


def test_conversations_fill_segments_and_tokens(spark, tmp_path):
    turns = [(c, t, ("user", "assistant")[t % 2], "word " * (3 + 900 * (c % 7 == t % 2 == 1))) for c in range(300) for t in range(2)] + [(1000, t, "assistant" if t % 5 else "user", "some more words ") for t in range(9000)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = packing.conversation_coverage(spark, str(tmp_path)).collect()
    assert len(rows) == 301 and all(r.whole and r.good for r in rows)
    by = {}
    for r in packing.conversation_packing(spark, str(tmp_path)).collect():
        by.setdefault(r.sequence_id, []).append(r)
    assert any(len(p) == packing.SEGMENTS for p in by.values()) and any(sum(r.length for r in p) == 1024 for p in by.values())


def test_packing_of_repeats_ties_and_prompts(spark):
    rows = [(1, "one two three " * 40, "one two")] * 30 + [(2, "", ""), (2, None, None), (3, "word " * 9000, "word " * 8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt string").repartition(2)
    got = packing.pack(df, prompt_column="prompt", max_segments=5, max_loss=600).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0) and sum(r.start == 0 for r in got) == len(rows)
    for part in by.values():
        assert len(part) <= 5 and sum(r.length for r in part) <= 1024 and sum(r.loss_tokens for r in part) <= 600
    assert sum(r.loss_tokens for r in got if r.doc_id == 3) == 1001  # 1000 words and the end


def test_packing_of_short_items_takes_classes():
    tokens = np.random.default_rng(3).integers(2, 6, 20000)
    bins = packing.Block(tokens, np.zeros(20000, np.int64), 1024, 512).pack()
    assert sum(x[2] for c in bins for x in c) == tokens.sum() and sum(sum(x[2] for x in c) < 1024 for c in bins) <= 10


def test_byte_bpe_of_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "")], SCHEMA).selectExpr("*", "1 as n_tokens", "'x' as bytes", "2 as ends")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in byte_bpe.digests(byte_bpe.encode(df)).collect())
    assert got == [(0, 0), (1, 2), (1, 2), (2, 0)]


def test_plain_words_go_past_the_normaliser():
    """Lower-case ASCII words meet the model alone, with and without capitals and marks; others meet the whole tokenizer."""
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["some plain words", "Some PLAIN (words) qzxvk, and-more!!", "", "  a  b\nc "]
    own = Encoder(public_tokenizers.path("word_bpe_49k.json"), False)

    class Counted:
        words = 0

        def encode_batch_fast(self, texts, **named):
            self.words += sum(len(t.split()) for t in texts)
            return whole.encode_batch_fast(texts, **named)

        def __getattr__(self, name):
            return getattr(whole, name)

    own.tokenizer = counted = Counted()
    ids, counts = own.encode(texts)
    assert counted.words == 0 and ids.tolist() == [i for t in texts for i in whole.encode(t, add_special_tokens=False).ids]
    odd = ["Stra\u00dfe \u00c0B \u00f7 \u00d7y na\u00efve!", "\u00aab \u00b5m e\u0301a K\u212a", "I\u0130 \u017ft's"]
    ids, counts = own.encode(odd)
    assert counted.words and ids.tolist() == [i for t in odd for i in whole.encode(t, add_special_tokens=False).ids]


def test_an_executors_caches_stay_small():
    """What the cache holds of each byte that it counts, times the two generations that four workers may fill."""
    path, bound = public_tokenizers.path("word_bpe_49k.json"), inspect.signature(repair.write).parameters["cache_bytes"].default
    rng, sizes, counted = random.Random(4), [], []
    texts = [" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(15000)) for _ in range(14)]
    own = Encoder(path, False, 8 << 20)
    own.encode(["warm Up!"])
    tracemalloc.start()
    try:
        for text in texts:
            own.encode([text])
            sizes.append(tracemalloc.get_traced_memory()[0])
            counted.append(own.now.bytes + own.old.bytes)
    finally:
        tracemalloc.stop()
    assert max(sizes[7:]) <= 1.25 * max(sizes[:7])  # full caches grow no more
    assert 4 * 2 * bound * max(sizes) / max(counted) < 800 << 20


def test_words_are_cached_without_marks_and_capitals():
    """One entry for a word whatever stands around it, and the library's ids also where a capital letter is composed with what follows."""
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = Encoder(path, False), Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = ["River, river! (RIVER) river-river.\n\tRiver", "Été... été, ÉTÉ"]
    ids, counts = own.encode(texts)
    assert set(own.now.pieces) == {"river", "été", ",", "!", "(", ")", "-", ".", "..."}
    odd = [*texts, "H\u0331 h\u0331 T\u0308x, AW\u030a! J\u030c", "endH", "\u0331begins", "À", "\u0300Â\u0301", "a,\u0301b <\u0338c =\u0338", "×÷ßÿÞØ ×A÷", "x's,'S 'tis. O'RE,'ll", "\r\x0b\x0cA\tB\x85C\xa0D ", "", "\n", "AİB ΣΣ, 1A2,3", "\U0001f600.A\U0001f600"]
    ids, counts = own.encode(odd)
    for text, e, n in zip(odd, np.cumsum(counts), counts):
        assert ids[e - n : e].tolist() == library.encode(text, add_special_tokens=False).ids, text
    marks = ["\u0331", "\u0308", "\u030a", "\u030c", "\u0338", "\u0301", "\u1161", "A", "H", "w", "J", "Â", "ê", ",", "=", "'", "s", "7", " ", "\n", "\u212a"]
    r = random.Random(31)
    mixes = ["".join(r.choices(marks, k=r.randint(0, 9))) for _ in range(3000)]
    ids, counts = own.encode(mixes)
    for text, e, n in zip(mixes, np.cumsum(counts), counts):
        assert ids[e - n : e].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_overlapping_pairs_of_a_round():
    """Of overlapping places whose pairs are equally frequent every other one stays, of others the more frequent."""
    rng = np.random.default_rng(8)
    for _ in range(40):
        ids = rng.choice(3, 200, p=[0.6, 0.3, 0.1]).astype(np.uint32)
        pairs = list(zip(ids.tolist(), ids[1:].tolist()))
        n = Counter(pairs)
        at = [i for i, p in enumerate(pairs) if n[p] >= 4]
        beats, weight, start = {}, [n[pairs[i]] for i in at], 0
        for k, i in enumerate(at):
            start = start if k and at[k - 1] == i - 1 and weight[k - 1] == weight[k] else k
            beats[i] = (k - start) % 2 == 0
        out = {i + (weight[k] >= weight[k + 1]) for k, i in enumerate(at[:-1]) if at[k + 1] == i + 1 and weight[k] != weight[k + 1] and beats[i] and beats[i + 1]}
        kept = [i for i in at if beats[i] and i not in out]
        uses = Counter(pairs[i] for i in kept)
        made = {p for p in uses if uses[p] >= 3}
        seq, _, rules, _ = repair.compress(ids, np.array([200]), 3, 4, 3)
        assert {tuple(p) for p in rules[: len(made)].tolist()} == made
