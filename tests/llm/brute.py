"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def base_scores(docs):
    tokens = {i: [*words(t), "</end>"] for i, t in docs}
    train = collections.Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(w)
    n, v = sum(train.values()), len(train)
    return n, {i: (len(w), sum(train[x] > 0 for x in w), sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens.items()}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def secret_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(x[2] for x in sorted(out))


def jaccard_components(docs):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def quality_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + d for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for d in range(3)}
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 50 or 100 * rep > 50 * n


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaks(docs, items, split, threshold=0.6, question_share=0.5, answer_share=0.5, k1=1.2, b=0.75, n=3):
    """{(doc_id, item_id): (best BM25 share of any window, question share, answer share)}."""
    bags = {i: words(t) for i, t in items}
    bags = {i: w for i, w in bags.items() if w}
    average = sum(map(len, bags.values())) / len(bags)
    df = collections.Counter(w for bag in bags.values() for w in set(bag))

    def impact(item, term):
        tf = bags[item].count(term)
        idf = math.log(1 + (len(bags) - df[term] + 0.5) / (df[term] + 0.5))
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(bags[item]) / average)) if tf else 0.0

    size = max(16, max(map(len, bags.values())))
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = {}
    for d, text in docs:
        own = words(text)
        for item in bags:
            total = sum(impact(item, t) for t in set(bags[item]))
            share = max((sum(impact(item, t) for t in set(own[at : at + 2 * size])) / total for at in range(0, len(own), size)), default=0.0)
            parts = []
            for part in split(dict(items)[item]):
                w = words(part)
                k = min(n, len(w))
                parts.append(len(grams(w, k) & grams(own, k)) / len(grams(w, k)) if k else 1.0)
            if share >= threshold - 1e-9 and parts[0] >= question_share and parts[1] >= answer_share:
                out[d, item] = (share, *parts)
    return out


def interpolated(docs, part, order, tolerance=1e-3):
    """{doc_id: log10 probability}: orders mixed from the bottom up, weights by context bucket from EM on the part-2 rows under the counts of the others."""
    tokens = {i: ["<b>", *words(t), "<e>"] for i, t in docs}

    def gram(w, p, k):
        return tuple(w[max(p - j, 0)] for j in range(k))

    def count(rows):
        out = collections.Counter()
        for w in rows:
            out.update(gram(w, p, k) for p in range(len(w)) for k in range(1, order + 1))
        n = sum(len(w) - 1 for w in rows)
        return out, n, len({x for w in rows for x in w[1:]})

    def levels(w, p, c, n, v):
        f, b = [c[gram(w, p, 1)] / max(n, 1)], [0]
        for k in range(2, order + 1):
            context = c[gram(w, p - 1, k - 1)]
            f.append(c[gram(w, p, k)] / max(context, 1))
            b.append(min(math.ceil(math.log2(context + 1)), 23))
        return f, b, 1 / (v + 1)

    def mix(lam, f, b, u):
        out = [u]
        for k in range(order):
            out.append(lam[k][b[k]] * f[k] + (1 - lam[k][b[k]]) * out[-1])
        return out

    kept = count([tokens[i] for i in tokens if part[i] == 1])
    rows = [levels(tokens[i], p, *kept) for i in tokens if part[i] == 2 for p in range(1, len(tokens[i]))]
    lam = [[0.5] * 24 for _ in range(order)]
    while True:
        taken, reached = [[1e-3] * 24 for _ in range(order)], [[2e-3] * 24 for _ in range(order)]
        for f, b, u in rows:
            p, left = mix(lam, f, b, u), 1.0
            for k in reversed(range(order)):
                reached[k][b[k]] += left
                own = left * lam[k][b[k]] * f[k] / p[k + 1]
                taken[k][b[k]] += own
                left -= own
        new = [[x / y for x, y in zip(t, r)] for t, r in zip(taken, reached)]
        moved = max(abs(x - y) for a, b in zip(new, lam) for x, y in zip(a, b))
        lam = new
        if moved < tolerance:
            break
    whole = count([tokens[i] for i in tokens if part[i] > 0])
    return {i: sum(math.log10(mix(lam, *levels(w, p, *whole))[-1]) for p in range(1, len(w))) for i, w in tokens.items()}
