"""op4 and op6 against plain Python versions that share none of their code."""

import math
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import decontamination, site_quality

from . import brute

SF = "/root/testdata/sf0.001"
LATIN_1 = {chr(c): chr(c + 32) for c in range(0xC0, 0xDF) if c != 0xD7}


def _folded(word):
    return "".join(LATIN_1.get(c, c.lower() if c.isascii() else c) for c in word)


def _tokens(text):
    """[(word as written, kind in each of the four templates, opens a sentence, begins a line)]"""
    out, since = [], "\n"
    for run in brute.WORD.finditer(text or ""):
        chars = [(i, c) for i, c in enumerate(run[0]) if c not in string.punctuation]
        if not chars:
            since += run[0] + " "
            continue
        word = "".join(c for _, c in chars)
        before = since + run[0][: chars[0][0]]
        out.append((word, bool(set(before) & set(".!?:\n")) or not out, "\n" in before or not out))
        tail = run[0][chars[-1][0] + 1 :]
        end = run.end()
        following = brute.WORD.search(text, end)
        since = tail + text[end : following.start() if following else len(text)]
    rows, number_before = [], False
    for word, opens, line in out:
        low = _folded(word)
        number = all(c in string.digits for c in word) or low in decontamination.NUMBER_WORDS
        unit = number_before and not number and low in decontamination.UNITS
        typed = 1 if number else 2 if unit else 0
        name = typed or (3 if word[0] in LATIN_1 or word[0] in string.ascii_uppercase else 0)
        rows.append((word, (typed if opens else name, typed, name, 0), opens, line))
        number_before = number
    return rows


def _template(tokens, variant):
    """[(kind, folded word or none, words of the slot, first token)]"""
    out = []
    for i, (word, kinds, opens, _) in enumerate(tokens):
        kind = kinds[variant]
        if out and kind in (1, 3) and out[-1][0] == kind and not opens:
            out[-1][2].append(word)
        else:
            out.append((kind, None if kind else _folded(word), [word], i))
    return out


def _slots(part):
    return [f"{kind}:{' '.join(words).lower()}" for kind, _, words, _ in part if kind]


def _contaminated(docs, items):
    """doc_id -> (items, any literal) of docs and items [(id, text)]."""
    classes, shown = {}, {}
    for item_id, text in items:
        tokens = _tokens(text)
        templates = [_template(tokens, v) for v in range(4)]
        words = tuple(x[1] for x in templates[3])
        named = []
        for t in templates[:3]:
            slots = _slots(t)
            named.append((tuple(x[:2] for x in t), tuple(slots.index(s) for s in slots)))
        named = tuple(named)
        any_window = False
        for v, t in enumerate(templates):
            k = min(8, len(t))
            wins = [(i, t[i : i + k]) for i in range(len(t) - k + 1 if k else 0)]
            wins = [(i, w) for i, w in wins if v == 3 or sum(x[0] == 0 for x in w) >= 4]
            if wins:
                any_window = True
                shape = ("words", words) if v == 3 else ("named", named)
                at = (shape, v)
                if at not in classes or (item_id, named == classes[at][1]) < (classes[at][0], True):
                    classes[at] = (item_id, named, k, wins)
        if any_window:
            shown[named] = min(shown.get(named, item_id), item_id)
    out = {}
    for doc_id, text in docs:
        tokens = _tokens(text)
        templates = [_template(tokens, v) for v in range(4)]
        found = []
        for (_, v), (_, named, k, wins) in classes.items():
            t, at = templates[v], {}
            for pos in range(len(t) - k + 1):
                part = t[pos : pos + k]
                begins = [x[3] for x in part]
                if k < 4 and not (tokens[begins[0]][3] and not any(tokens[j][3] for j in range(begins[0] + 1, begins[-1] + len(part[-1][2]))) and (begins[-1] + len(part[-1][2]) == len(tokens) or tokens[begins[-1] + len(part[-1][2])][3])):
                    continue
                for i, own in wins:
                    if [x[:2] for x in own] == [x[:2] for x in part]:
                        at.setdefault(pos - i, []).append((i, set(zip(_slots(own), _slots(part), strict=True))))
            runs = []
            for offset in sorted(at):
                if runs and offset - runs[-1][-1] <= 4:
                    runs[-1].append(offset)
                else:
                    runs.append([offset])
            for group in [[o] for o in at] + runs:
                places = {i for o in group for i, _ in at[o]}
                pairs = set().union(*(p for o in group for _, p in at[o]))
                one_way = len(pairs) == len({a for a, _ in pairs})
                other_way = len(pairs) == len({b for _, b in pairs})
                whole = v != 1 or len(places) == len(wins)
                if len(places) >= max(math.ceil(len(wins) * 0.5), 1) and one_way and (whole or other_way):
                    found.append((shown[named], all(a == b for a, b in pairs)))
        if found:
            out[doc_id] = (sorted({i for i, _ in found}), any(x for _, x in found))
    return out


ITEMS = [
    "Tom has 5 apples and buys 3 more. Tom gives 2 to Ann. How many apples does Tom have?",
    "A train leaves Paris at 40 miles per hour and reaches Lyon after 3 hours. How far is it?",
    "A train leaves Rome at 50 miles per hour and reaches Milan after 6 hours. How far is it?",
    "What is 17 times 23?", "Name it.", "Élodie paid 12 euros for twenty five pears, and Émile paid nothing at all.",
    "the quick brown fox jumps over the lazy dog near the quiet river bank", "", "?!", "2 3 4", "Which river flows through the old town of Bern?",
]
SWAPS = [("Tom", "Mary Jane"), ("Ann", "Bob"), ("5", "eleven"), ("3", "4"), ("17", "19"), ("Paris", "Oslo"), ("Lyon", "Oslo"), ("40", "2,000"), ("Bern", "Basel"), ("12", "90")]


def test_contamination_matches_brute_force(spark):
    rng = random.Random(21)
    filler = "of the and a to in with some water stone Green 12 hill. Then we saw\nthree".split(" ")
    blank = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    items = [(i, t) for i, t in enumerate(ITEMS)] + [(3, ITEMS[6] + " again and again"), (20, ITEMS[0])]
    docs = [(i, t) for i, t in enumerate(ITEMS)] + [(90, None), (91, ""), (92, blank(300))]
    for n in range(100, 260):
        text = rng.choice(ITEMS)
        for a, b in rng.sample(SWAPS, rng.randint(0, 4)):
            text = text.replace(a, b)
        parts = text.split(" ")
        for _ in range(rng.choice([0, 0, 0, 1, 2, 4])):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(filler))
        if rng.random() < 0.3:
            parts = parts[: rng.randint(1, len(parts))]
        join = rng.choice([" ", "\n", ". "])
        docs.append((n, blank(rng.randint(0, 12)) + join + " ".join(parts) + join + blank(rng.randint(0, 12))))
    want = _contaminated(docs, items)
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert 60 < len(want) < len(docs) - 20 and len(got) == len(docs)
    for r in got:
        assert (r["doc_id"], r["items"]) == (r["doc_id"], want.get(r["doc_id"], ([], True))[0])
        assert r["contaminated"] == (r["doc_id"] in want) and r["n_items"] == len(r["items"])
        assert r["reparameterised"] == (not want.get(r["doc_id"], ([], True))[1])


def _features(text):
    t = text or ""
    n, chars, symbols, dup, repeats = brute.base_counts(t)
    words, letters, lines = max(n, 1), max(chars, 1), t.count("\n") + 1
    count = lambda of: sum(t.count(c) for c in of)
    share = lambda x, y: min(x / y, 3.0)
    return [
        math.log1p(n), float(n < 50), chars / words / 10, share(symbols, words), share(count("!"), words), share(count("|"), words),
        share(count(string.ascii_uppercase), letters), share(count(string.digits), letters), share(dup, lines), share(repeats, words),
        share(count("#*$%&<>@^~=_{}[]\\/+"), words), float(n == 0),
    ]


def _strength(groups):
    """Pseudo documents by the method of moments, of (n, s, mean of the level above)."""
    own = [(n, s, m) for n, s, m in groups if n >= 2]
    total = sum(n * m * (1 - m) for n, _, m in own)
    spread = sum(n * (s / n - m) ** 2 for n, s, m in own)
    if not own or not total or not spread:
        return site_quality.MOST_STRENGTH
    each = sum(m * (1 - m) for _, _, m in own) / total
    rho = (spread / total - each) / max(1 - each, 1e-9)
    return min(max(1 / rho - 1, site_quality.LEAST_STRENGTH), site_quality.MOST_STRENGTH) if rho > 0 else site_quality.MOST_STRENGTH


def _sites(own):
    """(host, path) -> (host's mean, path's mean), and the global mean, of [(host, path, log-odds)]."""
    paths, hosts = {}, {}
    for host, path, x in own:
        p = 1 / (1 + math.exp(-x))
        for of, key in ((paths, (host, path)), (hosts, host)):
            n, s = of.get(key, (0, 0.0))
            of[key] = (n + 1, s + p)
    mean = sum(s for _, s in hosts.values()) / sum(n for n, _ in hosts.values())
    k = _strength([(n, s, mean) for n, s in hosts.values()])
    above = {h: (s + k * mean) / (n + k) for h, (n, s) in hosts.items()}
    k = _strength([(n, s, above[h]) for (h, _), (n, s) in paths.items()])
    return {(h, p): (above[h], (s + k * above[h]) / (n + k)) for (h, p), (n, s) in paths.items()}, mean


def test_site_quality_matches_brute_force(spark, odd_docs):
    """Features, evidence, shrunken posteriors, score and verdict; the weights are those of a fit that has no better neighbour."""
    names = ["doc_id", "text", "lang", "source"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*names).unionByName(odd_docs.select((F.col("doc_id") + 10_000_000).alias("doc_id"), *names[1:]))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] is not None}
    mean, deviation, weights = site_quality.fit(docs, labels)
    known = {}
    for r in labels.collect():
        if r["doc_id"] in rows and r["quality"] in (0, 1):
            known[r["doc_id"]] = min(known.get(r["doc_id"], 1), r["quality"])
    x = np.array([_features(rows[i]["text"]) for i in known])
    y = np.array(list(known.values()))
    assert mean == pytest.approx(x.mean(0)) and deviation == pytest.approx(np.maximum(x.std(0), 1e-6))

    def loss(w):
        z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-6) @ w[:-1] + w[-1]
        return np.logaddexp(0, np.where(y == 1, -z, z)).sum() + 0.5 * (w[:-1] ** 2).sum()

    for i in range(len(weights)):
        for step in (-0.05, 0.05):
            assert loss(weights + step * (np.arange(len(weights)) == i)) > loss(weights)
    own = lambda t: min(max(float(np.clip((np.array(_features(t)) - mean) / deviation, -8, 8) @ weights[:-1] + weights[-1]), -12.0), 12.0)
    every = [(r["source"], r["lang"], own(r["text"])) for r in docs.collect()]
    sites, middle = _sites(every)
    got = site_quality.classify(docs, labels).collect()
    assert len(got) == len(every)
    logit = lambda p: math.log(p / (1 - p))
    for r in got:
        assert (r["host_mean"], r["path_mean"]) == pytest.approx(sites[r["host"], r["path"]])
        if r["doc_id"] is not None:
            d = rows[r["doc_id"]]
            z = own(d["text"]) + 0.5 * (logit(sites[d["source"], d["lang"]][1]) - logit(middle))
            assert r["own"] == pytest.approx(own(d["text"])) and r["score"] == pytest.approx(1 / (1 + math.exp(-z)))
            assert abs(r["score"] - 0.5) < 1e-9 or r["kept"] == (r["score"] >= 0.5)
