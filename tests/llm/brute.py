"""The contracts of the op queries in plain Python, on lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def place(name):
    return float("-inf") if name is None else name


def repeats(rows, window=20):
    first = {}
    parts = [(name, WORD.findall(text or "")) for name, text in rows]
    for name, ws in parts:
        for s in range(len(ws) - window + 1):
            k = tuple(ws[s:s + window])
            first[k] = min(first.get(k, (float("inf"), 0)), (place(name), s))
    out = []
    for name, ws in parts:
        gone = set()
        for s in range(len(ws) - window + 1):
            if first[tuple(ws[s:s + window])] < (place(name), s):
                gone.update(range(s, s + window))
        out.append((name, len(ws), len(gone), sha(" ".join(w for k, w in enumerate(ws) if k not in gone))))
    return out


def shingles(text, size):
    ws = WORD.findall((text or "").translate(LOWER))
    if not ws:
        return []
    return [" ".join(ws[k:k + size]) for k in range(max(1, len(ws) - size + 1))]


def fingerprint(text, size=3):
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, size)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def classes(rows, links):
    """Smallest id of the class of each row; `links` says whether two rows link."""
    sets = Sets(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            if links(a, b):
                sets.join(a, b)
    names = defaultdict(list)
    for k, (name, _) in enumerate(rows):
        names[sets.find(k)].append(name)
    least = {k: min((n for n in v if n is not None), default=None) for k, v in names.items()}
    return [least[sets.find(k)] for k in range(len(rows))]


def simhash(rows):
    fps = [fingerprint(t) for _, t in rows]
    ids = classes(rows, lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    return [(name, f"{fp:016x}", c) for (name, _), fp, c in zip(rows, fps, ids)]


def jaccard(a, b, size=5):
    x, y = set(shingles(a, size)), set(shingles(b, size))
    return 1.0 if x == y else len(x & y) / len(x | y)


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def lines(rows):
    docs = defaultdict(set)
    for name, text in rows:
        for line in (text or "").split("\n"):
            docs[line_key(line)].add(place(name))
    shared = {k: max(v) for k, v in docs.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for name, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if shared.get(line_key(x), place(name)) == place(name)]
        out.append((name, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return out


def leaks(rows, items, window=10):
    grams = defaultdict(set)
    for item, text in items:
        ws = ITEM_WORD.findall((text or "").translate(LOWER))
        size = min(window, len(ws))
        for s in range(len(ws) - size + 1 if size else 0):
            grams[tuple(ws[s:s + size])].add(item)
    sizes = {len(g) for g in grams}
    out = []
    for name, text in rows:
        ws = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in sizes:
            for s in range(len(ws) - size + 1):
                if tuple(ws[s:s + size]) in grams:
                    hit.update(range(s, s + size))
                    found |= grams[tuple(ws[s:s + size])]
        found = sorted(str(x) for x in found if x is not None)
        out.append((name, len(ws), len(hit), len(found), sha(",".join(found)), bool(hit)))
    return out


def _spans(text, pattern, kind, good):
    return [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m)]


def secrets(text):
    text = text or ""
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ["password", "passwd", "secret", "token", "api_?key"])
    kinds = ["assign", "access", "hex"]
    out = _spans(text, f"({names})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "assign", lambda m: len(m[2]) >= 6)
    out += _spans(text, "AKIA[A-Z0-9]+", "access", lambda m: len(m[0]) >= 20)
    out += _spans(text, "[0-9a-f]+", "hex", lambda m: len(m[0]) >= 24)
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = _spans(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "email", lambda m: True)
    out += _spans(text, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "ip", lambda m: all(int(p) <= 255 for p in m[0].split(".")))
    out += _spans(text, r"[0-9]([\x20-]?[0-9])+", "card", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)))
    out += _spans(text, r"\+[0-9][\x20().0-9-]+[0-9]", "phone", lambda m: 9 <= len(digits(m)) <= 15)
    return out


def told(spans):
    return sha(",".join(f"{k}:{s}:{e}" for k, s, e in spans))


def cross_entropy(rows, marked, words=ITEM_WORD):
    """Leave-one-out losses as the language model operator defines them."""
    docs = [words.findall((t or "").translate(LOWER)) for _, t in rows]
    mine = [name is not None and name in marked for name, _ in rows]
    out = []
    for k, (name, _) in enumerate(rows):
        ws, losses = docs[k], []
        for target in (True, False):
            rest = [d for j, d in enumerate(docs) if j != k and d and (mine[j] or not target)]
            one, two = Counter(w for d in rest for w in d), Counter(p for d in rest for p in zip([None, *d], d))
            one[None] = len(rest)
            total = sum(map(len, rest))
            p = [(10 * (one[w] + 0.05) / (total + 0.05 * 2 ** 20) + two[u, w]) / (one[u] + 10) for u, w in zip([None, *ws], ws)]
            losses.append(float(-np.log(p).mean()) if ws else 0.0)
        out.append((name, len(ws), *losses, losses[1] - losses[0]))
    return out


LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def audit(rows, least_docs=10, top=10):
    """rows: (text, lang, source)."""
    held, df = defaultdict(Counter), Counter()
    groups = sorted({(lang or "", source or "") for _, lang, source in rows})
    for text, lang, source in rows:
        ws = LETTERS.findall((text or "").translate(LOWER))
        held[lang or "", source or ""].update(ws)
        df.update((lang or "", w) for w in set(ws))
    out = []
    shares = {}
    for lang, source in groups:
        kept = sorted(w for x, w in df if x == lang and df[x, w] >= least_docs)
        every = Counter()
        for g in groups:
            if g[0] == lang:
                every.update(held[g])
        for name, counts in (((lang, source), held[lang, source]), ((lang, None), every)):
            total = sum(counts[w] for w in kept) + 2 * len(kept)
            shares[name] = {w: 1 + 10 ** 9 * (counts[w] + 2) // total for w in kept}
    gap = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        mine, every = shares[lang, source], shares[lang, None]
        pairs = [(t, sum(gap(mine[w], shares[lang, t][w]) for w in mine)) for x, t in groups if x == lang and t != source]
        terms = [(w, gap(mine[w], every[w])) for w in mine if held[lang, source][w] and mine[w] > every[w]]
        for part, found in (("pair", pairs), ("term", terms)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(ranked[:top] if part == "term" else ranked, 1)]
    return out


def copies(rows):
    """(doc_id, keep_id, group_size, kept, digest) of (doc_id, text)."""
    groups = defaultdict(list)
    for k, (name, text) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), name is None, name or 0, k))
    out = [None] * len(rows)
    for text, members in groups.items():
        best = min(members)
        for m in members:
            out[m[3]] = (rows[m[3]][0], None if best[1] else best[2], len(members), m == best, sha(text))
    return out


def search(docs, items, top=10):
    """(item_id, rank, doc_id, score) of documents (doc_id, text) and items (item_id, text)."""
    counted = [(name, Counter(TERM.findall((text or "").translate(LOWER)))) for name, text in docs]
    counted = [(name, c) for name, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scored = []
        for name, c in counted:
            m = 10 + 90 * sum(c.values()) * n // length
            score = sum(int(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, name is None, name))
        out += [(item, k, name, -score) for k, (score, _, name) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return out
