"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


def words(text):
    return WORD.findall(text or "")


def key(doc_id):
    return LAST if doc_id is None else doc_id


def substrings(rows, width=50):
    """Rows (doc_id, n_words, n_removed, sha) in order of input."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, LAST), key(i))
    out = []
    for i, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < key(i):
                keep[k : k + width] = [False] * width
        left = " ".join(x for x, y in zip(w, keep, strict=True) if y)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(left.encode()).hexdigest()))
    return out


def edits(a, b):
    """Whether one word put in, left out or replaced makes a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def lines(rows, least=8):
    """(doc_id, text left) by comparing all pairs of lines."""
    every = []
    for n, (i, t) in enumerate(rows):
        for k, line in enumerate((t or "").split("\n")):
            w = tuple(words(line))
            if w:
                every.append(((key(i), k), n, w))
    gone = defaultdict(set)
    for place, n, w in every:
        for other, _, v in every:
            if other < place and (v == w or (len(v) >= least and len(w) >= least and edits(w, v))):
                gone[n].add(place[1])
                break
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[n])) for n, (i, t) in enumerate(rows)]


def shingles(text, width):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def components(rows, width=3, threshold=90):
    """(doc_id, size of set, smallest linked doc_id) by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= threshold * (len(sets[a]) + len(sets[b]) - i):
                parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[find(n)] = min(least.get(find(n), LAST), key(i))
    give = lambda k: None if k == LAST else k
    return [(i, len(sets[n]), give(least[find(n)])) for n, (i, _) in enumerate(rows)]


def measures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    w = words(text)
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    count = Counter(grams)
    covered = {p for k, g in enumerate(grams) if count[g] > 1 for p in range(k, k + 8)}
    own = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(own) - len(set(own)), len(covered)
