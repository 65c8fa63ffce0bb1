"""Plain versions of what the operators compute, for small tables."""

import re
import zlib
from collections import Counter
from math import log10

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


def shingles(text, n=5):
    words = text.lower().split()
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def groups(texts, similar=0.8):
    """Smallest id of the group of each id, by comparing all pairs. texts: id -> text, not null."""
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if texts[a] == texts[b] or jaccard(sets[a], sets[b]) >= similar:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def lm_tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def base_scores(texts, learn):
    """id -> (tokens, known, all learned, base score)."""
    tokens = {i: lm_tokens(t) for i, t in texts.items()}
    counts = Counter(w for i, t in tokens.items() if learn(i) for w in t)
    total, kinds = sum(counts.values()), len(counts)
    return {
        i: (len(t), sum(counts[w] > 0 for w in t), total, sum(log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t))
        for i, t in tokens.items()
    }


def remainder(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by
