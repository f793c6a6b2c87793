"""Small tables with copies, shared passages, odd rows; and plain re-statements of what the operators promise."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, seed string, key string, rest string"


def corpus(n: int = 60, seed: int = 3) -> list[tuple]:
    """doc_id, text, ..., with columns whose names the operators use inside."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 7))) for _ in range(400)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, base = text(70), text(160)
    out: list[str | None] = [None, "", "  \n\t ", "one", "A b\x0bc  d", base, base, base.upper(), text(3000), text(3000).replace(" ", "")]
    while len(out) < n:
        k = r.random()
        if k < 0.3:
            out.append(text(r.randint(1, 60)) + "\n" + passage + "\n" + text(r.randint(1, 60)))
        elif k < 0.5:
            words = base.split()
            for _ in range(r.randint(1, 12)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            out.append(" ".join(words))
        elif k < 0.6:
            out.append("\n".join([text(12)] * 3 + [text(9)]))
        else:
            out.append(text(r.randint(1, 200)))
    order = list(range(n))
    r.shuffle(order)
    return [(i, out[i], ("en", "de", None)[i % 3], "s", len(out[i] or ""), "x", "y", "z") for i in order]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def repeated_words(docs: dict[int, str | None], window: int) -> dict[int, tuple]:
    first: dict[tuple, int] = {}
    for i in sorted(docs):
        w = words(docs[i])
        for a in range(len(w) - window + 1):
            first.setdefault(tuple(w[a : a + window]), i)
    out = {}
    for i, t in docs.items():
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def repeated_bytes(docs: dict[int, str | None], window: int) -> dict[int, tuple]:
    seen: set[bytes] = set()
    out = {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - window + 1):
            x = b[a : a + window]
            if x in seen:
                gone[a : a + window] = b"\1" * window
            seen.add(x)
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def shingle_set(text: str | None, k: int = 5) -> frozenset:
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(nodes, linked) -> dict:
    parent = {i: i for i in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(nodes)
    for n, a in enumerate(order):
        for b in order[:n]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in nodes}


def jaccard_groups(docs: dict[int, str | None], percent: int = 75) -> dict[int, tuple]:
    sets = {i: shingle_set(t) for i, t in docs.items()}
    linked = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    found = components(sets, linked)
    return {i: (len(sets[i]), found[i]) for i in docs}


def tally(rows) -> Counter:
    return Counter(map(str, rows))
