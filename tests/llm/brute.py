"""Plain single-machine versions of the operators, for comparison on small tables."""

import base64
import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, k=5):
    words = SPACED.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def jaccard_components(docs, percent=80):
    """docs: (id, text) pairs with distinct ids -> {(id, n_shingles, component)}."""
    sets = {i: shingles(t) for i, t in docs}
    holders = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in sets.items():
        shared = defaultdict(int)
        for s in own:
            for j in holders[s]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), root(i)) for i in sets}


def without_repeats(docs, window=13):
    """docs: (id, text) -> rows (id, n_words, n_removed, kept_sha256)."""
    words = [(i, SPACED.findall(t or "")) for i, t in docs]
    first = {}
    for i, own in words:
        for k in range(len(own) - window + 1):
            key = tuple(own[k : k + window])
            first[key] = min(first.get(key, i), i)
    rows = []
    for i, own in words:
        gone = set()
        for k in range(len(own) - window + 1):
            if first[tuple(own[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        rows.append((i, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return rows


def contamination(docs, items, window=10):
    patterns = defaultdict(set)
    for item, text in items:
        own = ALNUM.findall((text or "").translate(LOWER))
        k = min(window, len(own))
        for i in range(len(own) - k + 1) if own else []:
            patterns[tuple(own[i : i + k])].add(str(item))
    lengths = {len(p) for p in patterns}
    rows = []
    for i, text in docs:
        own = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for m in lengths:
            for k in range(len(own) - m + 1):
                if x := patterns.get(tuple(own[k : k + m])):
                    hit.update(range(k, k + m))
                    found |= x
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        rows.append((i, len(own), len(hit), len(found), digest, bool(hit)))
    return rows


def archived(pages):
    """pages: (page_id, html) -> rows (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    largest = {}
    for i, html in pages:
        largest[html or ""] = max(largest.get(html or "", i), i)
    rows = []
    for i, html in pages:
        payload = (html or "").encode()
        keep = largest[html or ""]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        rows.append((i, len(payload), digest, "response" if i == keep else "revisit", None if i == keep else keep))
    return rows
