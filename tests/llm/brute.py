"""Plain Python versions of what the operators compute."""

import hashlib
import re

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower_ascii(t):
    return re.sub("[A-Z]", lambda m: m.group(0).lower(), t or "")


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(t))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_duplicates(docs, per_cent):
    """{id: (n_shingles, component)} of (id, text) rows with unique ids."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
              if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b])]
    root = components(ids, linked)
    return {i: (len(sets[i]), root[i]) for i in ids}


def contamination(docs, items):
    """[(id, n_words, n_hit, item ids)] of every row."""

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t))

    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        if n and i is not None:
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k : k + n]))
                if got:
                    found |= got
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return out


def items_sha256(ids):
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
