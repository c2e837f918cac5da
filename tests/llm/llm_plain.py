"""Plain versions of the operators over Python lists, for comparison."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def groups(nodes, links) -> dict:
    """Smallest connected node of each node."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text: str | None, width: int) -> frozenset:
    words = WORD.findall(lower(text or ""))
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def near_documents(docs: dict, width: int, percent: int = 80) -> dict:
    """doc_id to (n_shingles, component_id, kept)."""
    sets = {i: shingles(t, width) for i, t in docs.items()}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:]
             if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = groups(ids, links)
    return {i: (len(sets[i]), found[i], found[i] == i) for i in ids}


def targets(sizes: dict, weights=(5, 2, 1), limit=3) -> dict:
    """Share by weight, stop at the limit, share the excess again until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        left, rest = total - sum(full.values()), [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > limit * sizes[s] + 1e-9]
        if not over:
            return full | share
        full |= {s: float(limit * sizes[s]) for s in over}


def mix(docs: list[tuple]) -> dict:
    """(doc_id, source, text) with distinct ids to doc_id: (size, target, copies)."""
    size = {d: len(WORD.findall(t or "")) for d, _, t in docs}
    by_source = defaultdict(list)
    for d, s, _ in docs:
        by_source[s].append(d)
    goal = targets({s: sum(size[d] for d in ds) for s, ds in by_source.items()})
    out = {}
    for s, ds in by_source.items():
        words = sum(size[d] for d in ds)
        rate = goal[s] / words if words else 0.0
        u = int(hashlib.md5(("mix/" + ("" if s is None else "=" + s)).encode()).hexdigest()[:5], 16) / 2**20
        for i, d in enumerate(sorted(ds, key=lambda d: (size[d], d is not None, d))):
            out[d] = (size[d], goal[s], min(3, math.floor((i + 1) * rate + u) - math.floor(i * rate + u)))
    return out


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def within(a: str, b: str, most: int) -> bool:
    """Whether the distance is ``most`` or less, from the cells that such a path can cross."""
    row, far = dict(enumerate(range(min(len(b), most) + 1))), most + 1
    for i, x in enumerate(a, 1):
        following: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            following[j] = i if j == 0 else min(row.get(j - 1, far) + (x != b[j - 1]), row.get(j, far) + 1, following.get(j - 1, far) + 1)
        if min(following.values(), default=far) > most:
            return False
        row = following
    return row.get(len(b), far) <= most


def line_words(line: str) -> list[str]:
    return re.findall("[0-9a-z\x80-\U0010ffff]+", line.lower())


def simhash(words: list[str]) -> int:
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def dedup_lines(docs: list[tuple], similarity: float = 0.8) -> dict:
    """(doc_id, text) with distinct ids to doc_id: text."""
    first: dict[str, tuple] = {}
    for d, t in sorted((d for d in docs if d[1] is not None), key=lambda d: (d[0] is not None, d[0])):
        for i, line in enumerate(t.split("\n")):
            words = line_words(line)
            if words:
                first.setdefault(" ".join(words), (d, i))
    lines = list(first)
    links = []
    for a in range(len(lines)):
        for b in range(a):
            longer = max(len(lines[a]), len(lines[b]))
            if within(lines[a], lines[b], math.floor(longer * (1 - similarity) + 1e-9)):
                links.append((a, b))
    group = groups(range(len(lines)), links)
    place = {line: n for n, line in enumerate(lines)}
    # Lines were met in order, so the smallest of a group comes first.
    out = {}
    for d, t in docs:
        if t is None:
            out[d] = None
            continue
        kept = []
        for i, line in enumerate(t.split("\n")):
            words = " ".join(line_words(line))
            if not words or first[lines[group[place[words]]]] == (d, i):
                kept.append(line)
        out[d] = "\n".join(kept)
    return out
