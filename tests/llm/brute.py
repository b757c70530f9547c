"""Slow and plain versions of the operators, for comparison."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [l for l in text.split("\n") if WORD.search(l)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {p for i, x in enumerate(windows) if n[x] > 1 for p in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def line_dedup(docs):
    """(order, text) pairs in order to texts that are left."""
    seen, gone, out = set(), [], []
    for _, text in docs:
        lines = [] if text is None else text.split("\n")
        drop = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not WORD.search("".join(w)):
                continue
            if w in seen:
                drop |= {i, i + 1, i + 2}
            seen.add(w)
        gone.append(len(drop))
        out.append(None if text is None else "\n".join(l for i, l in enumerate(lines) if i not in drop))
    return out, gone


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(texts, threshold=0.8):
    """First member of each text's class and its number of links."""
    sets = [shingle_set(t) for t in texts]
    parent, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-12:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], links


def substrings(texts, length):
    """Kept bytes, bytes removed and runs removed for each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((np.frombuffer(d, np.uint8)[~gone].tobytes(), int(gone.sum()), runs))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def spans(text):
    """Base spans (kind, start, end)."""
    text = text or ""
    forms = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    tests = [lambda m, d: True, lambda m, d: all(int(p) <= 255 for p in m.split(".")),
             lambda m, d: 13 <= len(d) <= 19 and luhn(d), lambda m, d: 9 <= len(d) <= 15]
    return [(k, *m.span()) for k, (f, t) in enumerate(zip(forms, tests))
            for m in re.finditer(f, text) if t(m[0], re.sub("[^0-9]", "", m[0]))]


def span_text(found):
    names = ["email", "ip", "card", "phone"]
    return ",".join(f"{names[k]}:{a}:{b}" for k, a, b in found)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
