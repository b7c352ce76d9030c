"""Plain Python versions of what the operators compute."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(rows):
    """doc_id -> (set size, smallest linked doc_id) of rows (doc_id, text) with distinct ids."""
    sets = {}
    for i, t in rows:
        w = words(fold(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = list(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def passages(rows, window=50):
    """[(doc_id, n_words, n_removed, sha256)] of rows (doc_id, text)."""
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[j : j + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone |= set(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def base_counts(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    at = {}
    for j in range(len(w) - 2):
        at.setdefault(tuple(w[j : j + 3]), []).append(j)
    repeated = {j + k for v in at.values() if len(v) > 1 for j in v for k in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)
