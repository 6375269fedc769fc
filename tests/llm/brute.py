"""The operators' results by the shortest way there is, for small inputs."""

import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def rlz_removed(docs, window=20):
    """doc -> places of removed words, for unique non-null ids."""
    first, out = {}, defaultdict(set)
    for i in sorted(docs):
        w = words(docs[i])
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in first:
                out[i].update(range(s, s + window))
            first.setdefault(key, (i, s))
    return out


def repeated_bytes(docs, window=400):
    """doc -> places of removed bytes."""
    times, data = Counter(), {i: (t or "").encode() for i, t in docs.items()}
    for b in data.values():
        times.update(b[s : s + window] for s in range(len(b) - window + 1))
    out = defaultdict(set)
    for i, b in data.items():
        for s in range(len(b) - window + 1):
            if times[b[s : s + window]] > 1:
                out[i].update(range(s, s + window))
    return out


def shingles(text, k):
    w = words(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def components(docs, k, percent):
    """doc -> smallest id that links reach."""
    sets = {i: shingles(t, k) for i, t in docs.items()}
    by = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            by[g].add(i)
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in sets.items():
        shared = Counter(j for g in s for j in by[g] if j < i)
        for j, both in shared.items():
            if 100 * both >= percent * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in docs}


def tokens(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(text, items, window=20, percent=80, least=10):
    """ids of the items that overlap a text on some diagonal: matches along all diagonals, summed over each window; items of
    fewer than `least` tokens have to match in all."""
    a, out = np.array([hash(t) for t in tokens(text)], np.int64), set()
    for item, t in items:
        b = [hash(x) for x in tokens(t)]
        size, n, m = min(window, len(b)), len(a), len(b)
        if not m or n < size:
            continue
        upto = np.zeros((m + 1, n + 1), np.int32)
        for j in range(m):
            upto[j + 1, 1:] = upto[j, :-1] + (a == b[j])
        if (100 * (upto[size:, size:] - upto[: m + 1 - size, : n + 1 - size]) >= (percent if m >= least else 100) * size).any():
            out.add(item)
    return out


def deduped_lines(docs):
    """doc -> text without the lines of repeated three-line windows."""
    seen, out = set(), {}
    for i in sorted(docs):
        if docs[i] is None:
            out[i] = None
            continue
        raw = docs[i].split("\n")
        own = [(p, x.strip(" \t\n\x0b\x0c\r")) for p, x in enumerate(raw) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for s in range(len(own) - 2):
            key = tuple(x for _, x in own[s : s + 3])
            if key in seen:
                gone |= {p for p, _ in own[s : s + 3]}
            seen.add(key)
        out[i] = "\n".join(x for p, x in enumerate(raw) if p not in gone)
    return out
