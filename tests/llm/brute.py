"""Plain versions of the operators' contracts, for small tables held in memory."""

import hashlib
import re
from collections import Counter, defaultdict

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def roots(n, links):
    """Smallest index reachable from every index."""
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def shingles(text):
    words = SPACE_WORD.findall((text or "").translate(UPPER))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_duplicates(rows):
    """doc_id -> (n_shingles, component_id) of rows (doc_id, text), doc_ids unique."""
    rows = sorted(rows)
    sets = [shingles(t) for _, t in rows]
    links, postings = [], defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for sh in s for j in postings[sh])
        links += [(i, j) for j, c in common.items() if 100 * c >= 75 * (len(s) + len(sets[j]) - c)]
        for sh in s:
            postings[sh].append(i)
    return {rows[i][0]: (len(sets[i]), rows[r][0]) for i, r in enumerate(roots(len(rows), links))}


def repeats(texts, length=200):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    codes = [(t or "").encode() for t in texts]
    seen = Counter(c[i:i + length] for c in codes for i in range(len(c) - length + 1))
    out = []
    for c in codes:
        gone = bytearray(len(c))
        for i in range(len(c) - length + 1):
            if seen[c[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(c, gone, strict=True) if not g)
        out.append((len(c), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def hits(texts, items, size=13):
    """(n_words, n_hit, n_items, items_sha256, contaminated) of each text; items (item_id, text)."""
    words = lambda t: WORD.findall((t or "").translate(UPPER))
    wanted = defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wanted[tuple(w[i:i + k])].add(str(item))
    lengths, out = {len(g) for g in wanted}, []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if owners := wanted.get(tuple(w[i:i + k])):
                    hit |= set(range(i, i + k))
                    found |= owners
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def phrases(text):
    """(n_words, n_base, first_word, last_word, base_labels) of a text."""
    w, places, labels = WORD.findall((text or "").translate(UPPER)), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def edited(rows):
    """doc_id -> (n_chars, edited text, next doc_id) of rows (doc_id, text), doc_ids unique."""
    rows = sorted(((d, t or "") for d, t in rows), reverse=True)
    out = {}
    for (doc, text), (following, other) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        out[doc] = len(text), text[:len(text) - half] + other[:half], following
    return out
