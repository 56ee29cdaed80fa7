"""Plain re-statements of the operators' results, one document at a time."""

import collections
import hashlib
import re
import zlib

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASSIGN = re.compile(r"""(?:([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def spaced(text, lower=False):
    text = text or ""
    return SPACED.findall(text.translate(LOW) if lower else text)


def words(text):
    return WORD.findall((text or "").translate(LOW))


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found)


def rules(text):
    text = text or ""
    w = spaced(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {i for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for i in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def shingles(text):
    w = spaced(text, lower=True)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(texts, percent=75):
    """doc_id -> smallest id reachable."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def contamination(text, items, n=13):
    """(words, hit words, items) of one text against item_id -> text."""
    w, hit, found = words(text), set(), set()
    for item, t in items.items():
        v = words(t)
        for k in range(max(1, len(v) - n + 1)) if v else ():
            window = v[k : k + n]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(item)
    return len(w), len(hit), found


def is_held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
