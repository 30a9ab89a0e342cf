"""Plain Python versions of the operators, for small inputs."""

import collections
import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def base_counts(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    often = collections.Counter(zip(words, words[1:], words[2:]))
    cover = [False] * len(words)
    for i in range(len(words) - 2):
        if often[tuple(words[i : i + 3])] > 1:
            cover[i : i + 3] = [True] * 3
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(cover)


def without_repeats(rows, window=20):
    """{doc_id: (n_words, n_removed, sha256 of what stays)}"""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for j in range(len(words) - window + 1):
            key = tuple(words[j : j + window])
            if key in seen:
                gone[j : j + window] = [True] * window
            seen.add(key)
        out[i] = len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone) if not g).encode()).hexdigest()
    return out


def near_components(rows, n=5, percent=80):
    """{doc_id: (set size, smallest doc_id reachable by links)}"""
    sets = {}
    for i, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
