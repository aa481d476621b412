"""Brute-force versions of pipeline stages over a dict of texts."""

import re
from collections import defaultdict

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_line_texts(docs):
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(TABLE)
    held = defaultdict(set)
    for i, t in docs.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    return {i: t if t is None else "\n".join(x for x in t.split("\n") if len(held.get(key(x), ())) < 3 or i == max(held[key(x)])) for i, t in docs.items()}


def brute_near(docs, size):
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(TABLE))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for x in sets:
        for y in sets:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                comp[max(a, b)] = min(a, b)
    return {i: t for i, t in docs.items() if find(i) == i}


def brute_contaminated(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(TABLE))
    windows = set()
    for t in items:
        w = words(t)
        m = min(13, len(w))
        windows |= {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()
    out = {}
    for i, t in docs.items():
        w = words(t)
        hit = {k + j for m in {len(x) for x in windows} for k in range(len(w) - m + 1) if tuple(w[k : k + m]) in windows for j in range(m)}
        if not (hit and 20 * len(hit) >= len(w)):
            out[i] = t
    return out
