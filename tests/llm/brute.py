"""Brute-force versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACES.findall(text or "")


def removed(docs):
    """(id, text) rows to (id, bytes, removed, spans, hash of the rest)."""
    data = [((1 << 63) - 1 if i is None else i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, t in data:
        for p in range(len(t) - 49):
            key = t[p:p + 50]
            first[key] = min(i, first.get(key, i))
    out = []
    for (i, t), (raw, _) in zip(data, docs, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((raw, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text, shingle=3):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
    if not w:
        return 0
    grams = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(docs, distance=2):
    fps = [fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(docs[i][0])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [(docs[i][0], f"{fps[i]:016x}", least[root(i)]) for i in range(len(docs))]


def line_set(line):
    w = words(line.lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def without_repeats(docs):
    """(id, text) rows, ids unique, to (id, text, number of lines taken out)."""
    lines = sorted((((1 << 63) - 1 if i is None else i), k, i, line) for i, t in docs if t is not None for k, line in enumerate(t.split("\n")))
    sets = [line_set(line) for *_, line in lines]
    gone = set()
    for a in range(len(lines)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 5 * both >= 4 * len(sets[a] | sets[b]):
                gone.add((lines[a][2], lines[a][1]))
                break
    out = []
    for i, t in docs:
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        out.append((i, kept, sum(g[0] == i for g in gone)))
    return out


def sharded(docs, shards, text_hash):
    """(id, text) rows to (id, size, crc, shard, slot), given the order's hash of each text."""
    rows = sorted((text_hash[t or ""], i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    total, at, slots, out = sum(r[2] for r in rows), 0, {}, []
    for _, i, size, crc in rows:
        at += size
        shard = min(shards - 1, (2 * at - size) * shards // (2 * total))
        out.append((i, size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
    return out


def top_k(vectors, queries, k):
    out = []
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=False)), i) for i, v in vectors.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


KINDS = (
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""), 2, 12),
    ("access", re.compile(r"(AKIA[A-Z0-9]+)"), 1, 18),
    ("hex", re.compile(r"([0-9a-f]+)"), 1, 16),
)


def secrets(text, classes, allowed, window=20):
    import math

    text = text or ""
    base = [(m.start(), rank, m.end(), kind) for rank, (kind, pattern, group, least) in enumerate(KINDS) for m in pattern.finditer(text) if len(m[group]) >= least]
    more = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        if any(a < m.end() and m.start() < z for a, _, z, _ in base) or any(re.fullmatch(p, m[0]) for p in allowed):
            continue
        most = 0.0
        for i in range(len(m[0]) - window + 1):
            part = m[0][i:i + window]
            most = max(most, -sum(part.count(c) / window * math.log2(part.count(c) / window) for c in set(part)))
        bits = next(b for _, chars, b in classes if re.fullmatch(chars, m[0]))
        if most >= bits - 1e-9:
            more.append((m.start(), 3, m.end(), "entropy"))

    def told(spans):
        return ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(spans))

    return (*[sum(s[3] == k for s in base) for k in ("assign", "access", "hex")], hashlib.sha256(told(base).encode()).hexdigest(), told(base + more))


def quality(text):
    w = words(text)
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed


def best_fit(pieces, capacity):
    """(size, source, cluster) in order to bins, by trying every bin."""
    bins, out = [], []
    for size, source, cluster in pieces:
        fitting = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and source not in b["sources"] and cluster not in b["clusters"]]
        if fitting:
            left = min(fitting)[0]
            k = min((b["since"], i) for i, b in enumerate(bins) if (b["left"], i) in fitting and b["left"] == left)[1]
        else:
            bins.append({"left": capacity, "sources": set(), "clusters": set(), "since": 0})
            k = len(bins) - 1
        b = bins[k]
        out.append((k, capacity - b["left"]))
        b["left"] -= size
        b["sources"].add(source)
        b["clusters"].add(cluster)
        b["since"] = len(out)
    return out


def poisson_count(seed, doc_id, rate):
    import math

    u = int(hashlib.md5(f"{seed}:{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while u >= total and k < 10_000:
        k += 1
        p *= rate / k
        total += p
    return k
