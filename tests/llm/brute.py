"""Plain Python definitions that the operators are held against; nothing here is fast."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = {c: c + 32 for c in range(65, 91)}


def hexed(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def shingles(text):
    w = WORD.findall((text or "").translate(AZ))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def op1(docs):
    """docs: (doc_id, text) -> sorted (doc_id, n_shingles, component_id)."""
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            index[g].append(k)
    for k, (d, s) in enumerate(sets):
        both = Counter(j for g in s for j in index[g] if j < k)
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((root(d), root(sets[j][0])))
                parent[b] = a
    return sorted((d, len(s), root(d)) for d, s in sets)


def op4(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(AZ))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        if w:
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(i)
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= got
        ids = sorted(map(str, found))
        out.append((d, len(w), len(hit), len(ids), hexed(",".join(ids)), bool(hit)))
    return sorted(out)


def op6(docs, least=50):
    first = {}
    texts = sorted((d, (t or "").encode()) for d, t in docs)
    for d, b in texts:
        for k in range(len(b) - least + 1):
            first.setdefault(b[k : k + least], d)
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - least + 1):
            if first[b[k : k + least]] < d:
                gone[k : k + least] = b"\1" * least
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, hexed(bytes(c for c, g in zip(b, gone) if not g))))
    return sorted(out)


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def pii_ok(kind, m):
    d = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def op7(text):
    """n_email, n_ip, n_card, n_phone, base_sha256."""
    spans = [[(k, m.start(), m.end()) for m in re.finditer(p, text or "") if pii_ok(k, m[0])] for k, p in PII]
    return (*map(len, spans), hexed(",".join(f"{k}:{s}:{e}" for x in spans for k, s, e in x)))


def op10(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = WORD.findall(text)
    count = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    inside = {j for k in range(len(w) - 7) if count[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def mix_targets(sizes):
    """source -> target, by resharing the excess until none is above three times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), list(names), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 3 * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out
