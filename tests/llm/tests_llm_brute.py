"""Near-duplicate classes by all pairs, with strings and counters."""

import math
from collections import Counter


def _shingles(text):
    words = (text or "").lower().split()
    return Counter(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def _groups(keys, linked):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and linked(a, b):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: find(k) for k in keys}


def similarities(docs, rare=1 / 1024):
    """Weighted Jaccard similarity of every two distinct texts; of texts that share most shingles, one counts in the frequencies."""
    sets = {t: _shingles(t) for t in {t or "" for _, t in docs}}
    plain = lambda a, b: len(sets[a].keys() & sets[b].keys()) / max(1, len(sets[a].keys() | sets[b].keys()))
    leaders = set(_groups(list(sets), lambda a, b: plain(a, b) > 0.4).values())
    df = Counter(x for t in leaders for x in sets[t])
    n = len(leaders)
    weights = {t: {x: (1 + math.log(k)) * math.log1p(n / max(df[x], 1, n * rare)) for x, k in s.items()} for t, s in sets.items()}

    def likeness(a, b):
        u, v = weights[a], weights[b]
        both = sum(min(w, v[x]) for x, w in u.items() if x in v)
        total = sum(u.values()) + sum(v.values()) - both
        return both / total if total else 1.0

    return {(a, b): likeness(a, b) for a in sets for b in sets if a < b}


def check_classes(docs, class_of, similarity=0.8, margin=0.04):
    """Of (doc_id, text) with different ids: every two texts clearly above the similarity are in one class, every class is
    connected by links that are not clearly below it, and is named by its least id. Returns how many links there are."""
    sims = similarities(docs)
    texts = {t or "" for _, t in docs}
    own = {}
    for i, t in docs:
        assert own.setdefault(t or "", class_of[i]) == class_of[i], "equal texts apart"
    for (a, b), s in sims.items():
        assert s < similarity + margin or own[a] == own[b], (s, a[:80], b[:80])
    loose = _groups(list(texts), lambda a, b: sims[(a, b)] >= similarity - margin)
    members = {}
    for t in texts:
        members.setdefault(own[t], set()).add(loose[t])
    assert all(len(m) == 1 for m in members.values()), "texts together that are not alike"
    least = {}
    for i, t in docs:
        least[own[t or ""]] = min(i, least.get(own[t or ""], i))
    assert all(k == v for k, v in least.items())
    return sum(s >= similarity for s in sims.values())
