"""Plain versions of the corpus operators, for comparison."""

import re
from collections import defaultdict
from fractions import Fraction

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, n):
    w = words(text)
    if len(w) >= n:
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def jaccard_join(rows, n, least):
    """{row index: (size, component id, links)} of (id, text) rows, every pair compared."""
    sets = [shingles(t, n) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= least:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[top(k)].append(i)
    smallest = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return {k: (len(sets[k]), smallest[top(k)] if sets[k] else rows[k][0], links[k]) for k in range(len(rows))}


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def held_items(docs, items, n=5, share=0.8):
    """{(doc id, item id): containment} of all pairs."""

    def sets(text):
        w = plain_words(text)
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({" ".join(w)} if w else set())

    owned = {i: sets(t) for i, t in items}
    out = {}
    for d, t in docs:
        own = sets(t)
        for i, s in owned.items():
            if s and len(own & s) >= share * len(s):
                out[d, i] = len(own & s) / len(s)
    return out


def readings(texts, samples, alphabet=60, block=4096, symbols=20_000):
    """Phrases, blocks and symbols of each text in each language: [(blocks, symbols, [phrases by language])]."""
    seen = defaultdict(int)
    for _, t in samples:
        for c in t:
            if c.isalpha():
                seen[c.lower()] += 1
    known = set(sorted(seen, key=lambda c: (-seen[c], c))[:alphabet])

    def plain(text):
        return re.sub("_+", "_", "".join((c.lower() if c.lower() in known and len(c.lower()) == 1 else "?") if c.isalpha() else "_" for c in text))

    references = [plain(t)[:symbols] for _, t in samples]

    def phrases(text, reference):
        n = at = 0
        while at < len(text):
            step = 1
            while at + step < len(text) and text[at : at + step + 1] in reference:
                step += 1
            at, n = at + step, n + 1
        return n

    out = []
    for t in texts:
        own = plain(t or "")
        blocks = [own[k : k + block] for k in range(0, len(own), block)]
        out.append((len(blocks), len(own), [sum(phrases(b, r) for b in blocks) for r in references]))
    return out
