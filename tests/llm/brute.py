"""Plain single-machine versions of the operators' contracts."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(LOWER)


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return out


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [s for s in text.split("\n") if WORD.search(s)]
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    rep = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i:i + 5])] >= 2:
            rep.update(range(i, i + 5))
    n, r = len(w), len(rep)
    return (n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), r,
            n < 10 or 100 * r > 20 * n)


def shingles(text, n=3):
    w = WORD.findall(low(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def jaccard(rows, n=3, percent=90):
    """``{doc_id: (size, component)}`` by comparing all pairs of distinct sets."""
    by_set = defaultdict(list)
    for i, t in rows:
        if i is not None:
            by_set[shingles(t, n)].append(i)
    sets = sorted((s for s in by_set if s), key=len)
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if percent * len(sets[j]) > 100 * len(a):
                break
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[find(j)] = find(i)
    least = defaultdict(lambda: 1 << 62)
    for i, s in enumerate(sets):
        least[find(i)] = min(least[find(i)], *by_set[s])
    out = {d: (0, d) for d in by_set.get(frozenset(), [])}
    for i, s in enumerate(sets):
        out |= {d: (len(s), least[find(i)]) for d in by_set[s]}
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    found.sort()
    sha = hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in found).encode()).hexdigest()
    return tuple(sum(k == i for _, k, _ in found) for i in range(3)), sha
