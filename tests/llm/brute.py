"""Plain single-process versions of the operators, to hold results against."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import xxhash

WORD6 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate(AZ)


def fingerprint(text):
    words = WORD.findall(lower(text))
    if not words:
        return "0" * 16
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    out = 0
    for bit in range(64):
        if 2 * sum(x >> bit & 1 for x in h) > len(h):
            out |= 1 << bit
    return f"{out:016x}"


def roots(nodes, links):
    """Smallest node of each component."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(docs):
    """(doc_id, fingerprint, component) with unique ids."""
    fps = {d: fingerprint(t) for d, t in docs}
    ids = sorted(fps)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (int(fps[a], 16) ^ int(fps[b], 16)).bit_count() <= 2]
    root = roots(ids, links)
    return {d: (fps[d], root[d]) for d in ids}


def contamination(docs, items, n=13):
    windows = {}
    for item, text in items:
        words = WORD6.findall(lower(text))
        if not words or item is None:
            continue
        size = min(n, len(words))
        for i in range(len(words) - size + 1):
            windows.setdefault(tuple(words[i : i + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        words = WORD6.findall(lower(text))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                w = tuple(words[i : i + size])
                if w in windows:
                    found |= windows[w]
                    hit.update(range(i, i + size))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(words), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def gram_ranking(texts, size):
    counts = Counter()
    for text in texts:
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        for w in words:
            padded = f" {w} "
            counts.update(padded[1:-1])
            counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
            counts.update(padded[i : i + 3] for i in range(len(padded) - 2))

    def key(g):
        k = 0
        for c in g:
            k = k << 21 | ord(c)
        return k

    return sorted(counts, key=lambda g: (-counts[g], key(g)))[:size]


def language(text, profiles, size=400, ranked=300):
    own = gram_ranking([text], ranked)
    if not own or not profiles:
        return "und", 0.0
    best = None
    for lang in sorted(profiles):
        place = profiles[lang]
        gap = sum(min(size, abs(place[g] - i)) if g in place else size for i, g in enumerate(own))
        if best is None or gap < best[1]:
            best = (lang, gap)
    return best[0], 1 - best[1] / (size * len(own))


def profiles(docs, size=400):
    by = {}
    for text, lang in docs:
        if lang is not None and text is not None:
            by.setdefault(lang, []).append(text)
    return {lang: {g: i for i, g in enumerate(gram_ranking(texts, size))} for lang, texts in by.items()}


def base32_sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def kneser_ney(train, texts):
    """(tokens, known, base, score) of each text under a two-word model counted in dictionaries."""
    import math

    def tokens(text):
        return [*WORD.findall(lower(text)), None]

    uni, pairs = Counter(), Counter()
    for t in train:
        ws = tokens(t)
        uni.update(ws)
        pairs.update(zip(["<s>", *ws[:-1]], ws, strict=True))
    ctx, cont = Counter(), Counter()
    for (u, w), n in pairs.items():
        ctx[u] += n
        cont[w] += 1
    of_context = {u: [0, 0, 0] for u in ctx}
    for (u, _), n in pairs.items():
        of_context[u][min(n, 3) - 1] += 1

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        out = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
        return [d if 0 < d < k else 0.5 * k for k, d in zip((1, 2, 3), out, strict=True)]

    big, small = discounts(pairs.values()), discounts(cont.values())
    size, total, types = len(uni), sum(uni.values()), len(pairs)
    free = sum(small[min(c, 3) - 1] for c in cont.values()) / types if types else 1.0

    def prob(u, w):
        low = free / (size + 1)
        if cont[w]:
            low += (cont[w] - small[min(cont[w], 3) - 1]) / types
        if u not in ctx:
            return low
        n = pairs[u, w]
        high = n - big[min(n, 3) - 1] if n else 0
        return high / ctx[u] + sum(d * k for d, k in zip(big, of_context[u], strict=True)) / ctx[u] * low

    out = []
    for t in texts:
        ws = tokens(t)
        out.append(
            (
                len(ws),
                sum(uni[w] > 0 for w in ws),
                sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (size + 1))) for w in ws),
                sum(math.log10(prob(u, w)) for u, w in zip(["<s>", *ws[:-1]], ws, strict=True)),
            )
        )
    known = [*uni, "never seen"]
    sums = [sum(prob(u, w) for w in known) for u in ["<s>", *list(ctx)[:3], "never seen"]] if types else []
    return out, sums
