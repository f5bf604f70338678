"""Plain versions of the operators, for small tables."""

import re
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def substring_dedup(docs, size=13):
    """{id: (n_words, kept words)}"""
    first, out = {}, {}
    split = {d: WORD.findall(t or "") for d, t in docs}
    for d in sorted(split):
        for k in range(len(split[d]) - size + 1):
            first.setdefault(tuple(split[d][k : k + size]), d)
    for d, w in split.items():
        stay = [True] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < d:
                stay[k : k + size] = [False] * size
        out[d] = (len(w), " ".join(x for x, s in zip(w, stay, strict=True) if s))
    return out


def ngram_classes(docs, size=4, percent=85):
    """{id: (size of the set, component)}"""
    sets, held = {}, defaultdict(set)
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        for s in sets[d]:
            held[s].add(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in {d for s in sets[a] for d in held[s] if d > a}:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def contamination(docs, items, size=13):
    """{id: (n_words, n_hit, sorted item ids, contaminated)}"""
    windows = defaultdict(set)
    for i, t in items:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        n = min(size, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add(str(i))
    out = {}
    for d, t in docs:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        hit, held = [0] * len(w), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    held |= found
                    hit[k : k + n] = [1] * n
        out[d] = (len(w), sum(hit), sorted(held), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    return out


def quality(docs, min_words=20, window=8, repeat_percent=30, line_min_docs=20, line_percent=1, depleted_percent=50):
    """{id: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed lines)}"""
    norm = lambda x: re.sub("[\x20\x09-\x0d]+", " ", x.strip(" \t\n\x0b\f\r").lower())
    bodies, holders = defaultdict(set), defaultdict(set)
    for _, host, t in docs:
        if t is not None:
            bodies[host or ""].add(t)
        for line in (t or "").split("\n"):
            if WORD.search(line):
                holders[host or "", norm(line)].add(t)
    over = {k for k, v in holders.items() if len(v) > line_min_docs and 100 * len(v) > line_percent * len(bodies[k[0]])}
    out = {}
    for d, host, t in docs:
        t = t or ""
        w = WORD.findall(t)
        at = defaultdict(list)
        for k in range(len(w) - window + 1):
            at[tuple(w[k : k + window])].append(k)
        again = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + window)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        gone = [i for i, x in enumerate(t.split("\n")) if WORD.search(x) and (host or "", norm(x)) in over]
        n_gone = sum(len(WORD.findall(t.split("\n")[i])) for i in gone)
        failed = len(w) < min_words or 100 * len(again) > repeat_percent * len(w)
        depleted = n_gone > 0 and (100 * n_gone > depleted_percent * len(w) or len(w) - n_gone < min_words)
        out[d] = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed, not failed and not depleted, gone)
    return out


def line_dedup(docs, run=3, whole=50):
    """{id: text that stays}"""
    seen, out = {}, {}
    for d, t in sorted(docs):
        lines = t.split("\n") if t is not None else []
        some = [(i, " ".join(WORD.findall(x))) for i, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for n in range(1, run + 1):
            for k in range(len(some) - n + 1):
                key = tuple(x for _, x in some[k : k + n])
                if n == run or sum(len(x.split(" ")) for x in key) >= whole:
                    if seen.setdefault(key, (d, k)) != (d, k):
                        gone |= {i for i, _ in some[k : k + n]}
        out[d] = None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out
