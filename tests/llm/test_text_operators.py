"""Quality, near duplicates, repeated passages and pseudonyms on small texts, against plain Python."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from varve.llm import line_quality, ngram_join, pseudonyms, substring_dedup

from .brute import base_counts, luhn, near_components, without_repeats

EDGES = [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "a"), (9004, "a " * 300), (9005, "a b " * 150), (9006, "é " * 40), (9007, "x" * 20000)]
SCHEMA = "doc_id long, text string"


def texts(seed, copies=3):
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(45)]
    rows = []
    for _ in range(30):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([1, 3, 5, 6, 30, 60, 150]))]
        for _ in range(r.choice([1, 2, copies])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                words[r.randrange(len(words))] = r.choice([f"Z{r.randint(0, 99)}", words[0].upper()])
            words += passage[: r.randint(0, 45)] if r.random() < 0.4 else []
            rows.append((3 * len(rows), r.choice([" ", "\n", "  "]).join(words)))
    return rows + EDGES


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_base_counts():
    given = [t for _, t in texts(1)] + ["a\na\n\na b\n#|$ a b c a b c", "\n\n", "b\r\nb\r\n"]
    x = line_quality.Lines(pa.array(given, pa.string()))
    got = list(zip(*(v.tolist() for v in (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words))))
    assert got == [base_counts(t) for t in given]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    field = line_quality.Field(rng.normal(size=4), rng.normal(size=(2, 2)), rng.normal(size=2))
    x, first = rng.normal(size=(11, 4)).astype(np.float32), np.array([0, 3, 3, 4, 11])
    emit = x @ field.weights.astype(np.float32)

    def score(path, a):
        s = field.begin[path[0]] + path[0] * emit[a]
        return s + sum(field.moves[p, q] + q * emit[a + t + 1] for t, (p, q) in enumerate(zip(path, path[1:])))

    got = field.viterbi(x, first)
    for a, b in zip(first, first[1:]):
        if b > a:
            paths = [tuple(int(c) for c in np.binary_repr(k, b - a)) for k in range(1 << (b - a))]
            assert tuple(got[a:b]) == max(paths, key=lambda p: score(p, a))


def test_gradient_of_the_field():
    rng = np.random.default_rng(2)
    features, first = rng.normal(size=(9, 3)), np.array([0, 4, 5, 9])
    place = np.full((4, 3), -1)
    for i in range(3):
        place[: first[i + 1] - first[i], i] = np.arange(first[i], first[i + 1])
    gold, scale, params = rng.integers(0, 2, 9), rng.random(3) + 0.5, rng.normal(size=9)
    f = lambda p: line_quality.Field.likelihood(p, features, gold[np.maximum(place, 0)], place >= 0, np.maximum(place, 0), scale)
    value, grad = f(params)
    for k in range(9):
        step = np.eye(9)[k] * 1e-5
        assert abs((f(params + step)[0] - f(params - step)[0]) / 2e-5 - grad[k]) < 1e-6
    # against the sum over all labellings
    want = 0.0
    for i in range(3):
        own = range(first[i], first[i + 1])
        score = lambda path: params[7 + path[0]] + sum(params[3 + 2 * p + q] for p, q in zip(path, path[1:])) + sum(c * (features[k] @ params[:3]) for c, k in zip(path, own))  # noqa: B023, E731
        paths = [tuple(int(c) for c in np.binary_repr(k, len(own))) for k in range(1 << len(own))]
        want += scale[i] * (score(tuple(gold[list(own)])) - np.log(sum(np.exp(score(p)) for p in paths)))
    assert abs(value - want) < 1e-9


def test_boilerplate_within_a_good_document(spark):
    r = random.Random(8)
    line = lambda: " ".join(r.choice("cat sat mat dog ran far home day sun".split()) for _ in range(12)) + "."
    junk = lambda: " | ".join(r.choice("BUY NOW FREE CLICK".split()) + "##" for _ in range(6)) + " !!"
    rows, labels = [], []
    for i in range(150):
        lines = [junk() if i % 3 == 0 or k in (3, 4) and i % 2 else line() for k in range(60)]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(i % 3 != 0), 0))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels[:120], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in line_quality.judge(docs, line_quality.train(docs, marks)).collect()}
    for i in range(121, 150):
        assert got[i].content_lines == (0 if i % 3 == 0 else 58 if i % 2 else 60)


def test_field_learns_lines_and_judges(spark):
    good = ["The cat sat on the mat and slept all day long.\nIt was quite warm, and nobody came to see it at all."] * 1
    rows, labels = [], []
    r = random.Random(5)
    for i in range(120):
        clean = [" ".join(r.choice("cat sat mat dog ran far home day sun".split()) for _ in range(12)) + "." for _ in range(8)]
        junk = [" | ".join(r.choice("BUY NOW FREE CLICK HERE".split()) + "##" for _ in range(12)) + " !!" for _ in range(8)]
        rows.append((i, "\n".join(junk if i % 3 == 0 else clean)))
        labels.append((i, int(i % 3 != 0), 0))
    rows += [(i, t) for i, t in EDGES] + [(7000, good[0])]
    docs = frame(spark, rows)
    marks = spark.createDataFrame(labels[:90] + [(None, 1, 0), (5000, None, 1)], "doc_id long, quality int, toxic int")
    field = line_quality.train(docs, marks)
    got = {r.doc_id: r for r in line_quality.judge(docs, field).collect()}
    assert all(got[i].kept == (i % 3 != 0 and not got[i].base_failed) for i in range(90, 120))
    assert not got[9000].kept and got[9000].n_words == 0 and got[9004].base_failed
    assert sorted(r.doc_id for r in line_quality.retained(docs, field).collect()) == sorted(i for i, r in got.items() if r.kept)
    assert line_quality.train(docs, marks.limit(0)) is None and line_quality.judge(docs.limit(0), None).count() == 0
    extra = docs.union(docs.where("doc_id < 3")).selectExpr("doc_id", "text", "1 as n_words", "'x' as kept")
    assert line_quality.judge(extra, None).count() == len(rows) + 3 == line_quality.retained(extra, None).count() + line_quality.judge(extra, None).where("not kept").count()


def joined(df, **k):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df, **k).collect()}


@pytest.mark.parametrize("limits", [{}, {"block_grams": 300}])
def test_near_duplicates(spark, limits, monkeypatch):
    if limits:  # components in blocks, and frequent n-grams
        monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    rows = texts(2, 9)
    assert joined(frame(spark, rows), **limits) == near_components(rows)


def test_trie_finds_all_links():
    rng = np.random.default_rng(3)
    for _ in range(30):
        base = rng.choice(60, 25, replace=False).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(18, 26), replace=False), rng.integers(60, 70, rng.integers(0, 4)).astype(np.uint64)])) for _ in range(12)]
        trie = ngram_join.Trie(sets, 80)
        for i, s in enumerate(sets):
            want = [j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t))]
            assert sorted(trie.links(i)) == want


def first_linked(sets, percent=80):
    """For each set the first set that links connect it with, from all pairs."""
    values, often = np.unique(np.concatenate(sets), return_counts=True)
    values = values[often > 1]
    dense = np.array([np.isin(values, s) for s in sets], np.float32)
    size, overlap = np.array([len(s) for s in sets]), dense @ dense.T
    overlap[np.diag_indices(len(sets))] = size
    link = (100 + percent) * overlap >= percent * (size[:, None] + size)
    root = np.arange(len(sets))
    while True:
        least = np.where(link, root, len(sets)).min(1)
        least = least[least]
        if (least == root).all():
            return root.tolist()
        root = least


@pytest.mark.parametrize("table", [1 << 25, 1500])
def test_links_of_parts_that_passages_join(table, monkeypatch):
    """Clusters with passages in common, sets that nothing links, and nested ones; with few sets at once, too."""
    monkeypatch.setattr(ngram_join.Trie, "TABLE", table, raising=False)
    monkeypatch.setattr(ngram_join.Trie, "AT_ONCE", table, raising=False)
    rng = np.random.default_rng(5)
    for _ in range(12):
        passages, sets = [rng.integers(0, 1 << 40, 6) for _ in range(3)], []
        for _ in range(6):
            base = rng.integers(0, 1 << 40, rng.integers(5, 60))
            for _ in range(rng.integers(1, 12)):
                own = rng.choice(base, max(1, int(len(base) * rng.uniform(0.8, 1))), replace=False)
                sets.append(np.unique(np.concatenate([own, *(p for p in passages if rng.random() < 0.3), rng.integers(0, 1 << 40, rng.integers(0, 4))])).astype(np.uint64))
        sets += [np.arange(k, dtype=np.uint64) for k in range(1, 40)] + [sets[0], sets[3]]
        sets = [sets[i] for i in rng.permutation(len(sets))]
        assert list(ngram_join.linked(sets, 80)) == first_linked(sets)


def test_a_large_group_of_near_copies_takes_no_walk_for_each_pair():
    """Half of them link; by one Python step for each pair these took 36 CPU seconds."""
    rng = np.random.default_rng(6)
    base = np.arange(0, 4000, 10)
    sets = [np.unique(np.concatenate([rng.choice(base, 400 - int(k), replace=False), rng.integers(5000, 1 << 40, int(k))])).astype(np.uint64) for k in rng.integers(5, 50, 2200)]
    began = time.process_time()
    got = ngram_join.linked(sets, 80)
    assert time.process_time() - began < 15
    assert list(got) == first_linked(sets)


def test_near_duplicates_of_odd_rows(spark):
    many = "one two three four five six seven"
    rows = [(1, many), (1, many), (2, many.upper()), (None, many), (3, None)]
    df = frame(spark, rows).selectExpr("doc_id", "text", "7 as id", "'r' as rep", "1 as n_shingles")
    assert joined(df) == {1: (3, 1), 2: (3, 1), 3: (0, 3), None: (3, None)}
    assert joined(df.limit(0)) == {}


def test_a_repeated_id_is_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a), (3, b), (4, None), (4, b), (5, b)]
    got = ngram_join.join(frame(spark, rows)).collect()
    # the smallest text stands for the document; a null one before all others
    assert sorted(tuple(r) for r in got) == [(1, 26, 1), (2, 26, 1), (3, 36, 3), (4, 0, 4), (5, 36, 3)]


def removed(df, **k):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(substring_dedup.dedup(df, **k)).collect()}


def test_repeated_passages(spark):
    rows = texts(4, 5) + [(8000 + i, " ".join(f"q{j % 7}" for j in range(i, 90))) for i in range(4)]
    assert removed(frame(spark, rows)) == without_repeats(rows)


def test_no_automaton_takes_all_contexts_of_a_common_line(spark, monkeypatch):
    class Small(substring_dedup.Automaton):
        def add(self, symbols):
            super().add(symbols)
            assert len(self.next) < 3000

    monkeypatch.setattr(substring_dedup, "Automaton", Small)
    monkeypatch.setattr(substring_dedup, "MOST_CONTEXTS", 40, raising=False)
    r = random.Random(7)
    lines = [" ".join(f"c{i}w{j}" for j in range(8)) for i in range(300)]
    value = [substring_dedup.grams(substring_dedup.Words(pa.array([line])).hashes(), 8)[0] for line in lines]
    line = lines[int(np.argmin(value))]  # so small a hash is the anchor of nearly all its windows
    before, after = ([" ".join(f"{c}{r.randint(0, 10**6)}" for _ in range(20)) for _ in range(250)] for c in "ab")
    rows = [(i, f"{before[i]} {line} {after[i]}") for i in range(250)]
    rows += [(300 + i, f"{before[i]} {line} {after[i + 1]}") for i in range(0, 40, 3)] + [(400 + i, f"{line} {after[i][:60]}" * 2) for i in range(5)]
    assert removed(frame(spark, [*rows, rows[0], rows[-1]])) == without_repeats(rows)
    monkeypatch.setattr(substring_dedup, "MOST_CONTEXTS", 1)
    assert removed(frame(spark, texts(4, 5))) == without_repeats(texts(4, 5))


def test_repeated_passages_of_odd_rows(spark):
    long = " ".join(f"u{i}" for i in range(30))
    rows = [(1, long), (1, long), (2, long), (None, long), (3, None)]
    df = frame(spark, rows).selectExpr("doc_id", "text", "'m' as marks", "5 as rid", "array(1) as tags")
    got = {(r.doc_id, r.n_removed): r for r in substring_dedup.dedup(df).collect()}
    assert set(got) == {(1, 0), (2, 30), (None, 30), (3, 0)} and got[3, 0].text is None and got[2, 30].text.strip() == "" and got[1, 0].tags == [1]
    assert substring_dedup.dedup(df.limit(0)).count() == 0


def test_suffix_automaton():
    r = random.Random(6)
    for _ in range(50):
        automaton, sequences = substring_dedup.Automaton(), []
        for _ in range(4):
            words = [r.randint(0, 2) for _ in range(r.randint(0, 15))]
            want = []
            for i in range(len(words)):
                want.append(max(m for m in range(i + 2) if m == 0 or any(s[k : k + m] == words[i + 1 - m : i + 1] for s in sequences for k in range(len(s) - m + 1))))
            assert automaton.statistics(words) == want
            automaton.add(words)
            sequences.append(words)


def test_pseudonyms(spark):
    rows = ["card 4845168114407329 and 7536784127813050 4845168114407329 x", "ip 97.51.17.173 bad 300.1.1.1 v 1.2.3.4.5", "call +1 (017) 555-7713. or (212) 555-1212", "on 1984-02-29, 1985-02-29, 29/02/1984 12/31/1999", "123-45-6789 666-12-1234", "mail und.34@mail7.example.", 'token = "ede43f42c939b6405768150e041159052aabbccd"', "4111 1111 1111 1111", None, "", "no 12345", "4845168114407329", "x" * 30000 + " 97.51.17.173"]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, n_chars long").selectExpr("*", "1 as _pii_found", "'a' as m")
    got = [r for r in pseudonyms.pseudonymise(df, "it's a key").orderBy("doc_id").collect()]
    out = [r.text for r in got]
    assert [r.n_replaced for r in got] == [3, 1, 2, 3, 1, 1, 1, 1, 0, 0, 0, 1, 1]
    cards = re.findall(r"\d{16}", out[0])
    assert all(map(luhn, cards)) and cards[0] == cards[2] == out[11] != "4845168114407329"
    assert re.fullmatch(r"ip (\d+)\.(\d+)\.(\d+)\.(\d+) bad 300\.1\.1\.1 v 1\.2\.3\.4\.5", out[1]) and out[12].split()[1] == out[1].split()[1]
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}\. or \(\d{3}\) \d{3}-\d{4}", out[2])
    days = re.fullmatch(r"on (\d{4})-(\d\d)-(\d\d), 1985-02-29, (\d\d)/(\d\d)/(\d{4}) \d\d/\d\d/\d{4}", out[3])
    assert days[1] == days[6] and days[2] == days[5] and days[3] == days[4]  # one date in two forms
    assert out[4].endswith(" 666-12-1234") and not out[4].startswith("123-45-6789") and "@" in out[5] and out[5].endswith(".example.") and "und.34" not in out[5]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[6]) and "ede43f" not in out[6] and luhn(out[7].replace(" ", "")) and re.fullmatch(r"(\d{4} ){3}\d{4}", out[7])
    assert out[8] is None and out[9] == "" and got[8].n_chars is None and got[7].n_chars == len(out[7])


def test_pseudonyms_against_plain_python(spark):
    import datetime
    import hashlib

    def feistel(x, a, b, tweak):
        l, r = divmod(x, b)
        digest = lambda i, half: int(hashlib.sha256(f"k:{tweak}:{i}:{half}".encode()).hexdigest()[:15], 16)
        for i in range(10):
            l, r = ((l + digest(i, r)) % a, r) if i % 2 == 0 else (l, (r + digest(i, l)) % b)
        return l * b + r

    def card(d):
        body = f"{feistel(int(d[:-1]), 10 ** (len(d) // 2), 10 ** ((len(d) - 1) // 2), 'card'):0{len(d) - 1}d}"
        return next(body + c for c in "0123456789" if luhn(body + c))

    def day(y, m, d):
        return datetime.date(1900, 1, 1) + datetime.timedelta(feistel((datetime.date(y, m, d) - datetime.date(1900, 1, 1)).days, 17, 4297, "date"))

    phone = f"{feistel(2125551212, 10**5, 10**5, 'phone'):010d}"
    ip = feistel((97 << 24) + (51 << 16) + (17 << 8) + 173, 65536, 65536, "ip")
    v = feistel((122 * 99 + 44) * 9999 + 6788, 898 * 99, 9999, "ssn")
    area = v // 989901 + 1
    want = [card("4845168114407329"), day(1984, 2, 29).isoformat(), f"{phone[:3]}-{phone[3:6]}-{phone[6:]}", ".".join(str(ip >> s & 255) for s in (24, 16, 8, 0)), f"{area + (area > 665):03d}-{v // 9999 % 99 + 1:02d}-{v % 9999 + 1:04d}", day(2020, 1, 2).isoformat() + "T03:04:05"]
    rows = ["4845168114407329", "1984-02-29", "212-555-1212", "97.51.17.173", "123-45-6789", "2020-01-02T03:04:05"]
    df = spark.createDataFrame([*enumerate(rows), *enumerate(rows), (None, rows[0])], SCHEMA)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in pseudonyms.pseudonymise(df, "k").collect())
    assert got == sorted([*enumerate(want), *enumerate(want), (-1, want[0])])
    assert pseudonyms.pseudonymise(df.limit(0), "k").count() == 0


def test_the_permutation_is_one(spark):
    for a, b in ((17, 43), (10, 100), (1, 7)):
        sql = pseudonyms.feistel("id", a, b, "t").replace("{key}", "'k'")
        assert sorted(r[0] for r in spark.range(a * b).selectExpr(sql).collect()) == list(range(a * b))
