"""Plain Python forms of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text, fold=False):
    raw = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", raw.translate(FOLD) if fold else raw)


def shingles(text, k=5):
    w = words(text, True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(rows):
    """[(id, set size, least id of the group)] of (id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            lists[g].append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in lists[g] if j > i)
        for j, o in shared.items():
            if 100 * o >= 80 * (len(s) + len(sets[j]) - o):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for i in range(len(sets)):
        members[root(i)].append(i)
    out = []
    for own in members.values():
        least = min((rows[i][0] for i in own if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), least if sets[i] else rows[i][0]) for i in own]
    return out


def leaks(rows, items):
    found, sets = set(), {i: shingles(t) for i, t in items}
    for d, text in rows:
        own = shingles(text)
        for i, q in sets.items():
            if q and 10 * len(own & q) >= 8 * len(q):
                found.add((d, i, len(q), len(own & q)))
    return found


def without_repeats(rows, window=35):
    texts = [words(t) for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def base_counts(text):
    w, t = words(text), text or ""
    again = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if again[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed
