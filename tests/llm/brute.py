"""Plain Python versions of the numbered queries, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text, pattern=SPACE_WORD):
    return pattern.findall((text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_duplicates(docs, k, percent=80):
    """{doc_id: (n_shingles, component_id)}, comparing all pairs of different sets."""
    sets = {d: shingle_set(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        if s:
            holders[s].append(d)
    kinds = list(holders)
    ends = [(holders[s][0], holders[s][0]) for s in kinds]
    for s in kinds:
        for d in holders[s]:
            ends.append((holders[s][0], d))
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    ends.append((holders[a][0], holders[b][0]))
    for x, y in ends:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def personal_base(text):
    """[(kind, start, end)] of the four base kinds, by kind and start."""
    text, out = text or "", []
    n_digits = lambda m: sum(c.isdigit() for c in m)
    tests = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= n_digits(m) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= n_digits(m) <= 15),
    )
    for kind, pattern, test in tests:
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if test(m[0])]
    return out


def secrets_base(text):
    text, out = text or "", []
    kinds = ("assign", "access", "hex")
    for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], kinds.index(x[0])))


def spans_text(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def held_out(doc_id, parts):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == 2


def unigram(docs):
    """{doc_id: (n_tokens, n_known, base_score)}, N."""
    end = object()
    tokens = [(d, [*words(t), end]) for d, t in docs]
    counts = Counter(x for d, ts in tokens if not held_out(d, 7) for x in ts)
    n, v = sum(counts.values()), len(counts)
    return {d: (len(ts), sum(counts[x] > 0 for x in ts), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in ts)) for d, ts in tokens}, n


def quality(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in full)
        rest = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if level * weight[s] > epochs * sizes[s]}
        if not over:
            return {s: float(epochs * sizes[s]) if s in full else level * weight[s] for s in names}
        full |= over


def contamination(docs, items, size=10):
    """[(doc_id, n_words, n_hit, n_items, items_sha256)]"""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text, ALNUM_WORD)
        m = min(size, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i : i + m])].add(str(item))
    lengths = sorted({len(x) for x in windows})
    out = []
    for d, text in docs:
        w, hit, found = words(text, ALNUM_WORD), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if owners := windows.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    found |= owners
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found)))))
    return out


def simhashes(docs, size=3, bits=2):
    """[(doc_id, fingerprint, component_id)], comparing all pairs of fingerprints."""
    import xxhash

    prints = []
    for _, text in docs:
        w = words(text)
        hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), seed=42) for i in range(max(1, len(w) - size + 1))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = components(prints, bits)
    least = {}
    for (d, _), p in zip(docs, prints):
        known = [x for x in (least.get(root[p]), d) if x is not None]
        least[root[p]] = min(known) if known else None
    return [(d, f"{p:016x}", least[root[p]]) for (d, _), p in zip(docs, prints)]


def components(prints, bits):
    """{fingerprint: the smallest that links reach}"""
    kinds, root = sorted(set(prints)), {}
    for p in kinds:
        if p in root:
            continue
        root[p], queue = p, [p]
        while queue:
            a = queue.pop()
            for b in kinds:
                if b not in root and (a ^ b).bit_count() <= bits:
                    root[b] = p
                    queue.append(b)
    return root


def resampled(docs, target, max_words=1, n_buckets=10_000, min_words=20, percent=10, seed=2024):
    """[(doc_id, n_features, weight, score, rank)]"""

    def features(text):
        w = words(text, ALNUM_WORD)
        return Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % n_buckets for k in range(1, max_words + 1) for i in range(len(w) - k + 1)), len(w)

    mine = [features(t) for _, t in docs]
    s, t = Counter(), Counter()
    for f, _ in mine:
        s.update(f)
    for text in target:
        t.update(features(text)[0])
    s_all, t_all = float(s.total()), float(t.total())
    gain = {b: math.floor(1000 * math.log((float(t[b]) + 1) * (s_all + n_buckets) / ((float(s[b]) + 1) * (t_all + n_buckets)))) for b in s}
    out = []
    for (d, _), (f, n) in zip(docs, mine):
        h = int(sha(f"{seed}:{'' if d is None else d}")[:8], 16)
        weight = sum(gain[b] * c for b, c in f.items())
        out.append((d, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((i for i, r in enumerate(out) if r[4] >= min_words), key=lambda i: (-out[i][3], out[i][0] is not None, out[i][0] or 0, out[i][1], out[i][2]))
    rank = {i: k for k, i in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*r[:4], rank.get(i)) for i, r in enumerate(out)]


def phrase_counts(texts, max_words=4):
    """{lang: {words: occurrences}} of (lang, text) rows."""
    counts = defaultdict(Counter)
    for lang, text in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, max_words + 1):
                counts["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return counts


def collocations(texts, max_words=4, min_count=30, percent=80, most=2000):
    """[(lang, rank, phrase, a, l, r, n, score)]"""
    out = []
    for lang, f in phrase_counts(texts, max_words).items():
        n = sum(c for w, c in f.items() if len(w) == 1)
        good = {w: a for w, a in f.items() if len(w) > 1 and a >= min_count}
        longer = Counter()
        for w, a in good.items():
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    longer[w[i : i + m]] = max(longer[w[i : i + m]], a)
        found = []
        for w, a in good.items():
            if w in longer and 100 * longer[w] >= percent * a:
                continue
            score, k = min((2_000_000 * a // (f[w[:k]] + f[w[k:]]), k) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return out
