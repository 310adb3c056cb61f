"""Brute-force versions that the operators are held against, and small odd inputs."""

import hashlib
import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"

# Nulls, empty and blank texts, ties, a very long text, characters of several bytes, repeated rows.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the old house"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the old house"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "einzeln"),
    (7, "äöü ßé 日本語 слово"),
    (8, "word " * 4000 + "end"),
    (None, "no key here at all but words enough to count"),
    (9, "same row"),
    (9, "same row"),
    (10, "\n\n\n"),
]


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def jaccard_components(rows, n, share, of):
    """{doc_id: (set size, component)} and links by document, over all pairs."""
    rows = [(i, shingle_set(t, n)) for i, t in rows if i is not None]
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            x, y = rows[a][1], rows[b][1]
            if x and y and of * len(x & y) >= share * len(x | y):
                links[rows[a][0]] += 1
                links[rows[b][0]] += 1
                p, q = top(rows[a][0]), top(rows[b][0])
                root[max(p, q)] = min(p, q)
    return {i: (len(s), top(i)) for i, s in rows}, links


def without_repeats(texts, length):
    """(bytes, removed, runs, sha256 of the rest, the rest) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def greedy_tiling(document, item, tile):
    """Tiles by looking for the longest unmarked match again and again."""
    in_document, in_item, found = [False] * len(document), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(document)):
                n = 0
                while i + n < len(item) and d + n < len(document) and item[i + n] == document[d + n] and not in_item[i + n] and not in_document[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < tile:
            return found
        in_item[i : i + n] = in_document[d : d + n] = [True] * n
        found.append((i, d, n))
