"""Plain versions of the operators, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def window_dedup(rows, window=20):
    """(doc_id, text) rows with distinct ids to {doc_id: (n_words, n_removed, sha)}."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def span_dedup(rows, span=50):
    """To {doc_id: (n_bytes, n_removed, n_spans, sha)}."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        mine = set()
        for i in range(len(raw) - span + 1):
            key = raw[i : i + span]
            if key in seen:
                gone[i : i + span] = [True] * span
            mine.add(key)
        seen |= mine
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(text, k):
    w = words(ascii_lower(text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def near_components(rows, k=3, percent=85):
    """To {doc_id: (n_shingles, component)}."""
    sets = {d: shingle_set(t, k) for d, t in rows}
    having = {}
    for d, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for d, s in sets.items():
        common = {}
        for x in s:
            for e in having[x]:
                if e < d:
                    common[e] = common.get(e, 0) + 1
        for e, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    again = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    return (
        len(w),
        sum(map(len, w)),
        sum(text.count(c) for c in "#*$%&|<>"),
        dup,
        len(again),
        len(w) < 10 or 100 * len(again) > 20 * len(w),
    )
