"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def repeated_bytes(texts, span=200):
    """For each text (bytes length, removed, runs, kept bytes)."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - span + 1):
            if seen[d[i:i + span]] > 1:
                gone[i:i + span] = b"\x01" * span
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def repeated_passages(rows, window=50):
    """For each (id, text) (words, removed, kept text)."""
    first = {}
    split = [(i, words(t)) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def shingle_set(text):
    w = [x.lower() for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def near_duplicates(rows, percent=85):
    """{id: (shingles, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in rows}
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    linked = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = components(sets, linked)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def quality_counts(text):
    raw = (text or "").encode()
    w = words(text)
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line.encode()):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i:i + 8])] > 1:
            again.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return (len(w), sum(len(x.decode()) for x in w), len(re.findall(rb"[#*$%&|<>]", raw)), dup, len(again), failed)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def band_verdict(text):
    """Whether compression ratios accept a text: whole, and by every piece."""
    import zstandard

    raw = (text or "").encode()
    if len(raw) < 64:
        return True

    def fine(part):
        ratio = len(zstandard.ZstdCompressor(level=3).compress(part)) / len(part)
        lowest, highest = [0.45, 0.42, 0.40, 0.37, 0.33, 0.30, 0.28, 0.26, 0.24, 0.20], [1.15, 1.05, 0.93, 0.85, 0.78, 0.72, 0.70, 0.70, 0.70, 0.70]
        row = sum(len(part) >= limit for limit in (128, 256, 512, 1024, 2048, 4096, 8192, 16384, 65536))
        return lowest[row] <= ratio <= highest[row]

    pieces = []
    while len(raw) - sum(map(len, pieces)) >= 4096 + 512:
        at = sum(map(len, pieces))
        pieces.append(raw[at:at + 4096])
    pieces.append(raw[sum(map(len, pieces)):])
    return fine(raw) and 4 * sum(len(p) for p in pieces if not fine(p)) < len(raw)


def quality_keeps(text):
    return not quality_counts(text)[-1] and band_verdict(text)


def toxicity_chain(texts, labels, categories):
    """{id: probabilities} and {id: rejected} of a chain fitted on {id: {category: 0, 1 or None}}, with dense matrices."""
    import numpy as np

    def words_of(text):
        found = {w.strip(b".,;:!?\"'()[]{}- \t\n\x0b\x0c\r") for w in text.encode().lower().split()} - {b""}
        for n in (4, 5):
            found |= {w[:n] + b"*" for w in found if len(w) > n + 1}
        return found

    ids = sorted(i for i in labels if texts.get(i) is not None and any(v is not None for v in labels[i].values()))
    found = {i: words_of(texts[i]) for i in ids}
    chosen = set()
    for c in categories:
        have = [i for i in ids if labels[i][c] is not None]
        yes, no = [i for i in have if labels[i][c]], [i for i in have if not labels[i][c]]
        if not yes or not no:
            continue
        counts, of_yes = Counter(w for i in have for w in found[i]), Counter(w for i in yes for w in found[i])
        for w, n in counts.items():
            if max(sum(w in found[i] for i in ids if labels[i][k] is not None) for k in categories) >= 5:
                share = n / len(have)
                error = (share * (1 - share) * (1 / len(yes) + 1 / len(no)) + 1e-12) ** 0.5
                if abs(of_yes[w] / len(yes) - (n - of_yes[w]) / len(no)) / error >= 4:
                    chosen.add(w)
    words = sorted(chosen)
    matrix = lambda sets: np.array([[float(w in s) for w in words] for s in sets]).reshape(len(sets), len(words))
    chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def logistic(x, y):
        weight = np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, len(y) - y.sum())))
        x1 = np.column_stack([x, np.ones(len(y))])
        scale = np.append(x.mean(axis=0) + 0.01, 1.0)
        w, speed = np.zeros(x1.shape[1]), np.zeros(x1.shape[1])
        for _ in range(200):
            step = x1.T @ ((chance(x1 @ w) - y) * weight) / len(y) + np.append(0.002 * w[:-1], 0)
            speed = 0.9 * speed - 0.3 * step / scale
            w = w + speed
        return w

    x, every = matrix([found[i] for i in ids]), matrix([words_of(t or "") for t in texts.values()])
    fold = np.arange(len(ids)) % 4
    threshold = 1.0
    for c in categories:
        y = np.array([np.nan if labels[i][c] is None else labels[i][c] for i in ids], float)
        known, unseen = ~np.isnan(y), np.zeros(len(ids))
        if len(set(y[known])) < 2:
            p, threshold = np.full(len(every), chance(-30.0)), 1.0
        else:
            for k in range(4):
                w = logistic(x[known & (fold != k)], y[known & (fold != k)])
                unseen[fold == k] = chance(x[fold == k] @ w[:-1] + w[-1])
            w = logistic(x[known], y[known])
            p = chance(every @ w[:-1] + w[-1])
            tried = []
            for t in sorted(set(unseen[known]), reverse=True):
                hit = unseen[known] >= t
                precision, recall = y[known][hit].mean(), y[known][hit].sum() / y[known].sum()
                below = [u for u in unseen[known] if u < t]
                tried.append((1.25 * precision * recall / max(0.25 * precision + recall, 1e-9), t, (t + max(below, default=0.0)) / 2))
            threshold = max(tried, key=lambda r: (r[0], r[1]))[2]
        x, every = np.column_stack([x, unseen]), np.column_stack([every, p])
    out = every[:, len(words):]
    return {i: row for i, row in zip(texts, out)}, {i: bool(row[-1] >= threshold and threshold < 1) for i, row in zip(texts, out)}
