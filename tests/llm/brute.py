"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def text_stats(text):
    text = text or ""
    words = SPACE_WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if SPACE_WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


def contamination(text, items):
    """items: (id, text). Words, words hit, ids of items hit."""
    words = PLAIN_WORDS.findall(lower(text))
    hit, found = set(), set()
    for item, body in items:
        own = PLAIN_WORDS.findall(lower(body))
        size = min(10, len(own))
        for k in range(len(own) - size + 1) if size else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[k : k + size]:
                    hit.update(range(i, i + size))
                    found.add(item)
    return len(words), len(hit), {str(x) for x in found if x is not None}


def shingles(text):
    words = SPACE_WORDS.findall(lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard_components(docs):
    """docs: id -> text."""
    sets = {k: shingles(t) for k, t in docs.items()}
    parent = {k: k for k in docs}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in ids}


def removed_lines(docs, least=20):
    """docs: (id, text) in order. Kept text per document."""
    seen, out = set(), []
    for _, text in docs:
        if text is None:
            out.append(None)
            continue
        lines, gone, fresh = text.split("\n"), set(), set()
        counts = [len(SPACE_WORDS.findall(x)) for x in lines]
        for i in range(len(lines)):
            n, e = 0, i
            while e < len(lines) and n < least:
                n += counts[e]
                e += 1
            if n >= least:
                unit = tuple(lines[i:e])
                if unit in seen:
                    gone.update(range(i, e))
                seen.add(unit)
        seen |= fresh
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def removed_bytes(texts, span=400):
    """Removal mask per text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + span] for r in raw for i in range(len(r) - span + 1))
    out = []
    for r in raw:
        mask = bytearray(len(r))
        for i in range(len(r) - span + 1):
            if count[r[i : i + span]] > 1:
                mask[i : i + span] = b"\x01" * span
        out.append((r, mask))
    return out


def water_fill(budget, children):
    """children: name -> (weight, capacity). Whole-number shares."""
    open_, shares, left = dict(children), {}, budget
    while open_:
        weight = sum(w for w, _ in open_.values())
        full = {k: c for k, (w, c) in open_.items() if c * weight <= w * left}
        if not full:
            return shares | {k: w * left // weight for k, (w, _) in open_.items()}
        first = min(full, key=lambda k: (children[k][1] / children[k][0], k))
        shares[first] = full[first]
        left -= full[first]
        del open_[first]
    return shares


def best_paths(messages):
    """messages: (id, parent, score). Best leaf per root with the path from the root."""
    ids = {m for m, _, _ in messages}
    parent = {m: p if p in ids else None for m, p, _ in messages}
    score = {m: s or 0 for m, _, s in messages}
    leaves = ids - {p for p in parent.values() if p is not None}
    best = defaultdict(list)
    for leaf in leaves:
        path, at = [], leaf
        while at is not None:
            path.append(at)
            at = parent[at]
        best[path[-1]].append((-sum(score[x] for x in path), leaf, path[::-1]))
    return {root: min(paths)[2] for root, paths in best.items()}
