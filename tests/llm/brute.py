"""Plain versions of the operators, as their contracts state them."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), s)


def op1(text):
    t = text or ""
    w = SPLIT.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if c[g] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if SPLIT.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


def op1_verdict(rows, min_docs=10, min_share=0.005, least_left=0.5, fold=True):
    """rows (doc, text, host) → (doc, words in lines that stay, hashes of lines removed as a number, kept) of each."""
    def norm(x):
        x = re.sub(r"[ \t\n\x0b\f\r]+", " ", x.lower()).strip(" ")
        return re.sub("[0-9]+", "0", x) if fold else x

    has, hosts = defaultdict(set), defaultdict(set)
    lines = lambda t: [x for x in (t or "").split("\n") if SPLIT.search(x)]
    for d, t, h in rows:
        hosts[h].add(d)
        for x in lines(t):
            has[h, norm(x)].add(d)
    bad = {k for k, v in has.items() if len(v) >= min_docs and len(v) > min_share * len(hosts[k[0]])}
    out = []
    for d, t, h in rows:
        gone = {norm(x) for x in lines(t) if (h, norm(x)) in bad}
        left = sum(len(SPLIT.findall(x)) for x in lines(t) if norm(x) not in gone)
        n, *_, failed = op1(t)
        out.append((d, left, len(gone), not failed and left >= least_left * n))
    return out


def op4(docs):
    least = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            least[s] = min(least.get(s, d), d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out)


def op5(docs):
    rows = [(d, SPLIT.findall(t or "")) for d, t in docs]
    c = Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    out = []
    for d, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if c[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return sorted(out)


def fingerprint(text) -> int:
    w = SPLIT.findall(lower(text or ""))
    if not w:
        return 0
    k = min(3, len(w))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def op6(docs):
    fps = [(d, fingerprint(t)) for d, t in docs]
    label = {f: f for _, f in fps}

    def top(f):
        while label[f] != f:
            f = label[f]
        return f

    all_ = sorted(label)
    for i, a in enumerate(all_):
        for b in all_[:i]:
            if (a ^ b).bit_count() <= 2:
                label[top(a)] = top(b)
    least = defaultdict(lambda: math.inf)
    for d, f in fps:
        least[top(f)] = min(least[top(f)], d)
    return sorted((d, f"{f:016x}", least[top(f)]) for d, f in fps)


def op8(docs, items):
    grams = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall(lower(t or ""))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[i : i + n])].add(str(item))
    sizes = {len(g) for g in grams}
    out = []
    for d, t in docs:
        w = ALNUM.findall(lower(t or ""))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if g := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= g
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def op2(docs, good, mu=2.0):
    """Place of a row → (loss under the target model, under the background model) of its words and end, both without the row."""
    rows = [SPLIT.findall(t or "") for _, t in docs]
    seen = Counter(w for r in rows for w in r)
    vocabulary = {w for w, c in seen.items() if c >= 2} | {"</s>", "<unk>"}
    rows = [["<s>", *(w if w in vocabulary else "<unk>" for w in r), "</s>"] for r in rows]
    target = [d in good for d, _ in docs]
    sizes = [sum(len(r) - 1 for r, t in zip(rows, target) if t == side) for side in (False, True)]
    scale = sizes[1] / sizes[0] if all(sizes) else 1.0
    count = {side: Counter() for side in (False, True)}
    for r, t in zip(rows, target):
        count[t].update(r[1:])
        count[t].update(zip(r, r[1:]))
        count[t]["<s>"] += 1

    def model(side, without):
        """P(w after v) of a model that hasn't counted the row `without`."""
        own = Counter()
        if without is not None and target[without] == side:
            own.update([*rows[without], *zip(rows[without], rows[without][1:])])
        c = lambda x: (scale if not side else 1.0) * (count[side][x] - own[x])
        total = sum(c(w) for w in vocabulary)
        p1 = lambda w: (c(w) + 1) / (total + len(vocabulary))
        return lambda v, w: (c((v, w)) + mu * p1(w)) / (c(v) + mu)

    def loss(i, side):
        p = model(side, i)
        return -sum(math.log(p(v, w)) for v, w in zip(rows[i], rows[i][1:])) / (len(rows[i]) - 1)

    return [(loss(i, True), loss(i, False)) for i in range(len(rows))], model, vocabulary
