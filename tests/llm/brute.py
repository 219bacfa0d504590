"""Plain Python versions of the operators, quadratic where that is simplest."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s):
    return WORD.findall(s or "")


def shingles(s, n=5):
    w = words(ascii_lower(s or ""))
    return frozenset([tuple(w)] if 0 < len(w) < n else (tuple(w[i : i + n]) for i in range(len(w) - n + 1)))


def similar(rows, n=5, num=90, den=100):
    """{(row, n_shingles, n_similar, component)} of [(doc_id, text)]."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    deg = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * den >= num * max(len(a), len(b)):
                k = len(a & b)
                if den * k >= num * (len(a) + len(b) - k):
                    deg[i] += 1
                    deg[j] += 1
                    root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(s), g, low.get(find(i))) for i, ((d, _), s, g) in enumerate(zip(rows, sets, deg))), key=str)


def backoff_scores(texts, order, alpha):
    """(n_words, log_score) of each text, by counting all others anew."""
    import math
    from collections import Counter

    docs = [words(ascii_lower(t or "")) for t in texts]
    counts = [Counter(tuple(d[i : i + k]) for k in range(1, order + 1) for i in range(len(d) - k + 1)) for d in docs]
    every = sum(counts, Counter())
    out = []
    for d, own in zip(docs, counts):
        n = sum(map(len, docs)) - len(d)
        c = lambda g: every[g] - own[g]
        total = 0.0
        for i, w in enumerate(d):
            for k in range(min(order - 1, i), -1, -1):
                g = tuple(d[i - k : i + 1])
                if k and c(g):
                    total += math.log(c(g) / c(g[:-1]))
                    break
                if not k:
                    total += math.log(c(g) / n) if c(g) else math.log(1 / (n + 1))
                else:
                    total += math.log(alpha)
        out.append((len(d), total))
    return out


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def gone_lines(rows, least=5):
    """{(doc_id, line)} of [(doc_id, text)] that have an earlier near line."""
    lines = []
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            w = words(ascii_lower(x))
            if w:
                lines.append(((d is None, d or 0, i), d, i, w))
    lines.sort(key=lambda x: x[0])
    out = set()
    for k, (at, d, i, w) in enumerate(lines):
        for at2, _, _, v in lines[:k]:
            if at2 < at and (v == w or min(len(v), len(w)) >= least and abs(len(v) - len(w)) <= 1 and word_distance(v, w) <= 1):
                out.add((d, i))
                break
    return out
