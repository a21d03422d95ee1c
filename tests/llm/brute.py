"""Plain re-statements of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[max(self.find(a), self.find(b))] = min(self.find(a), self.find(b))


def near_lines(docs, n=8, least=0.8):
    """(doc_id, line_no) -> (keep_doc_id, keep_line_no, group size)"""
    places = [(i, k, line.strip(" \t\x0b\x0c\r")) for i, t in docs for k, line in enumerate((t or "").split("\n"))]
    places = sorted((p for p in places if p[2]), key=lambda p: (p[0] is None, p[0] or 0, p[1]))
    sets = [{x[i : i + n] for i in range(max(1, len(x) - n + 1))} for _, _, x in places]
    groups = Groups(len(places))
    for i in range(len(places)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= (least - 1e-12) * len(sets[i] | sets[j]):
                groups.join(i, j)
    size = Counter(groups.find(i) for i in range(len(places)))
    return {(p[0], p[1]): (*places[groups.find(i)][:2], size[groups.find(i)]) for i, p in enumerate(places)}


def simhash(text):
    words = (text or "").translate(LOWER)
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(docs):
    prints = [simhash(t) for _, t in docs]
    groups = Groups(len(docs))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                groups.join(i, j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        least[groups.find(i)].append(doc)
    return sorted((doc, f"{prints[i]:016x}", min(least[groups.find(i)])) for i, (doc, _) in enumerate(docs))


def contamination(docs, items, window=13):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    known = defaultdict(set)
    for item, text in items:
        words = word.findall((text or "").translate(LOWER))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            known[tuple(words[i : i + window])].add(str(item) if item is not None else "")
    out = []
    for doc, text in docs:
        words, hit, found = word.findall((text or "").translate(LOWER)), set(), set()
        for key, owners in known.items():
            for i in range(len(words) - len(key) + 1):
                if tuple(words[i : i + len(key)]) == key:
                    hit.update(range(i, i + len(key)))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return out


def targets(sizes, weights=(1, 2, 3), most=3):
    """source -> target by sharing again and again"""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        out = {s: most * sizes[s] if s in full else rest * weight[s] / share for s in order}
        over = {s for s in order if s not in full and out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over
