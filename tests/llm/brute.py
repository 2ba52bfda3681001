"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def runs(mask):
    return int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())


def suffix(docs, width):
    """{key: (n_bytes, n_removed, n_spans, sha)} for (key, text) rows."""
    raw = {k: (t or "").encode() for k, t in docs}
    where = defaultdict(list)
    for k, b in raw.items():
        for i in range(len(b) - width + 1):
            where[b[i : i + width]].append((k, i))
    gone = {k: np.zeros(len(b), bool) for k, b in raw.items()}
    for at in where.values():
        if len(at) > 1:
            for k, i in at:
                gone[k][i : i + width] = True
    return {k: (len(b), int(gone[k].sum()), runs(gone[k]),
                hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[k]].tobytes()).hexdigest()) for k, b in raw.items()}


def blocks(docs, width):
    """{key: (n_words, n_removed, sha)} for (key, doc_id, text) rows."""
    first = {}
    for _, d, t in docs:
        w = words(t)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, d), d)
    out = {}
    for key, d, t in docs:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[key] = (len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out


def closure(keys, links):
    """{key: smallest key reachable}."""
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {k: find(k) for k in keys}


def jaccard(docs, n=5, threshold=0.8):
    """{key: (n_links, class)} for (key, text) rows."""
    sets = {}
    for k, t in docs:
        w = words(t)
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    keys, links, count = list(sets), [], defaultdict(int)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                both = len(x & y)
                if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                    links.append((a, b))
                    count[a] += 1
                    count[b] += 1
    root = closure(keys, links)
    return {k: (count[k], root[k]) for k in keys}


def cosine(vectors, least=0.95):
    """{key: (n_links, component)} for (key, list) rows."""
    unit = {}
    for k, v in vectors:
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            unit[k] = x / np.linalg.norm(x)
    keys, links, count = list(unit), [], defaultdict(int)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links.append((a, b))
                count[a] += 1
                count[b] += 1
    root = closure([k for k, _ in vectors], links)
    return {k: (count[k], root[k]) for k, _ in vectors}
