"""Plain Python versions of the operators, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def near_components(texts):
    """doc_id -> (set size, smallest reachable doc_id)."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def exact(rows):
    """doc_id -> (keep_id, group_size, sha) for (doc_id, text) rows."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), sha(flat)) for flat, g in groups.items() for _, i in g}


def edited(texts):
    """doc_id -> (edited text, next doc_id)."""
    ids = sorted(texts, reverse=True)
    out = {}
    for n, i in enumerate(ids):
        own, following = texts[i] or "", texts[ids[(n + 1) % len(ids)]] or ""
        third = len(own) // 3
        out[i] = (own[:len(own) - third] + following[:third], ids[(n + 1) % len(ids)])
    return out
