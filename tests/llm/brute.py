"""The operators' results by the plainest Python, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(UPPER)


def words(text):
    return SPACE.findall(lower(text))


def test_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


test_words.__test__ = False


def rest(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def hit_words(text, items, n=10):
    """(number of words, hit words, items with an occurrence) for items: (id, text)."""
    doc, hit, found = test_words(text), set(), set()
    for item_id, item in items:
        w = test_words(item)
        k = min(len(w), n)
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(doc) - k + 1):
            if k and tuple(doc[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                if item_id is not None:
                    found.add(str(item_id))
    return len(doc), len(hit), sorted(found)


def simhash(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """For each fingerprint the index of its component, by all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def mix_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Target by source, sharing what is over the caps again until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def shingle_set(text, width=4):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def jaccard_components(rows, percent=85):
    """(doc_id, set size, smallest doc_id of the component) of each row (doc_id, text), by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    own = {}
    for i, (doc_id, _) in enumerate(rows):
        own.setdefault(find(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in own.items()}
    return [(doc_id, len(s), least[find(i)]) for i, ((doc_id, _), s) in enumerate(zip(rows, sets, strict=True))]


def kmeans(rows, k=8, rounds=10, dimensions=64):
    """{vec_id: (cluster, distance)}, centroids: in Python's integers and fractions."""
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, *near(v)[::-1]) for i, v in kept], centroids


def resampled(docs, target, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) of each row (doc_id, text)."""

    def features(text):
        w = test_words(text)
        return [zlib.crc32(x.encode()) % buckets for x in [*w, *map(" ".join, zip(w, w[1:], strict=False))]], len(w)

    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, f, _ in own for b in f), Counter(b for x in target for b in features(x)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    told = []
    for i, f, n in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        told.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    open_ = sorted((r for r in told if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(open_[: len(open_) * 25 // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in told]
