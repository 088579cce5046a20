"""Plain re-statements of the operators' contracts, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def licences(text):
    """n_words, n_base, first, last, base labels"""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by",
               "mit license": "mit"}
    places, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)))


def repeated(docs):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)} for [(doc_id, text)] with distinct ids"""
    seen, out = {}, {}
    raws = {k: (t or "").encode() for k, t in docs}
    for k in sorted(raws):
        for i in range(len(raws[k]) - 99):
            seen.setdefault(raws[k][i:i + 100], (k, i))
    for k, raw in raws.items():
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 99):
            if seen[raw[i:i + 100]] != (k, i):
                gone[i:i + 100] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[k] = (len(raw), int(gone[:len(raw)].sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d if d < 10 else d - 9
    return total % 10 == 0


def personal(text):
    """[(start, kind, end)] of the base patterns"""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+".replace(r"[\x20-]", "[ -]"), text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def base_digest(text):
    kinds = ("email", "ip", "card", "phone")
    line = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in personal(text))
    return hashlib.sha256(line.encode()).hexdigest()


def rule_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text = text or ""
    words = SPACE.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(hit), n < 50 or 100 * len(hit) > 50 * n)


def shingles(text, size=4):
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, 1)))


def near_groups(docs, size=4, percent=80):
    """{doc_id: (n_shingles, component)} by comparing all pairs that share a shingle"""
    sets = {k: shingles(t, size) for k, t in docs}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    inter = Counter()
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1:]:
                inter[a, b] += 1
    for (a, b), n in inter.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def nearest(vectors, k=20, every=20):
    """{query: [(vec_id, score)]}"""
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], float)
    out = {}
    for i, q in vectors:
        if i % every == 0:
            scores = (x * np.array(q, float)).sum(1)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(scores[j])) for j in order]
    return out
