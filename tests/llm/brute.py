"""Plain versions of what the operators compute, for small tables."""

import hashlib


def words_of(text):
    return (text or "").encode().split()


def without_repeated(rows, window=13):
    """[(id, n_words, n_removed, kept)] for (id, text) rows; a null id is the largest."""
    first = {}
    for doc, text in rows:
        order = float("inf") if doc is None else doc
        words = words_of(text)
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            first[w] = min(first.get(w, order), order)
    out = []
    for doc, text in rows:
        order = float("inf") if doc is None else doc
        words = words_of(text)
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < order:
                gone.update(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc, len(words), len(gone), kept.decode()))
    return out


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def components(rows, size, percent):
    """[(id, n, component)] of (id, text) rows with distinct ids, by all pairs."""
    sets = {doc: shingle_set(text, size) for doc, text in rows}
    by_set = {}
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(x, y):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)

    for doc, s in sets.items():
        if s:
            by_set.setdefault(s, []).append(doc)
    for docs in by_set.values():
        for doc in docs:
            join(docs[0], doc)
    heads, lists = {s: docs[0] for s, docs in by_set.items()}, {}
    for s, doc in heads.items():
        common = {}
        for g in s:
            for other in lists.setdefault(g, []):
                common[other] = common.get(other, 0) + 1
            lists[g].append(doc)
        for other, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[other]) - c):
                join(doc, other)
    return sorted((doc, len(s), root(doc)) for doc, s in sets.items())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
