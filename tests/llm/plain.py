"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib

import numpy as np

from reconcilia.llm import hd_langid


def shingles(text, k):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components_of(texts, k, share):
    """The first place of each text's component."""
    sets, root = [shingles(t, k) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def one_edit(a, b):
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(rows, least):
    """(doc_id, place) of every line to drop, by comparing all pairs of distinct lines; -1 for a null id."""
    first = {}
    for doc, text in rows:
        for place, line in enumerate(text.split("\n") if text is not None else []):
            if line:
                at = (-1 if doc is None else doc, place)
                first[line] = min(first.get(line, at), at)
    long = [x for x in first if len(x.split(" ")) >= least]
    near = {x for x in long for y in long if first[y] < first[x] and one_edit(x.split(" "), y.split(" "))}
    places = [(-1 if doc is None else doc, place, line) for doc, text in rows if text is not None for place, line in enumerate(text.split("\n")) if line]
    return {(doc, place) for doc, place, line in places if line in near or first[line] != (doc, place)}


def bundle(text):
    """A text's hyperdimensional vector, component by component."""
    base = hd_langid.letter_vectors(hd_langid.DIMENSIONS).astype(int)
    out = np.zeros(hd_langid.DIMENSIONS, int)
    letters = re.sub(r"0+", "0", "".join(chr(48 + int(hd_langid.symbols()[ord(c)])) for c in f" {(text or '').lower()} "))
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        x, y, z = (base[ord(v) - 48] for v in (a, b, c))
        for k in range(len(out)):
            out[k] += x[k - 2] * y[k - 1] * z[k]
    return out if re.search(r"[^\W\d_]", text or "") else out * 0


def language(text, prototypes):
    """(language, cosine at least 0); und without a letter."""
    v = bundle(text)
    if not v.any():
        return "und", 0.0
    cosines = {g: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for g, p in prototypes.items()}
    best = max(sorted(cosines), key=cosines.get)
    return best, max(0.0, cosines[best])


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3


def mixed(rows, weights=(5, 2, 1), epochs=3):
    """Texts that each (doc_id, source, text) row gives, in the mix: water-filling by repeated clamping, then an ordered walk. Ids are unique."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size(t) for _, o, t in rows if o == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, free = {}, set(sources)
    while True:
        rest = sum(own.values()) - sum(target.values())
        over = {s for s in free if epochs * own[s] * sum(weight[x] for x in free) <= weight[s] * rest}
        if not over:
            break
        target |= {s: epochs * own[s] for s in over}
        free -= over
    target |= {s: weight[s] * rest / sum(weight[x] for x in free) for s in free}
    out = {}
    for s in sources:
        whole = min(epochs, int(target[s] // max(own[s], 1)))
        left = round(target[s]) - whole * own[s]
        for doc, _, text in sorted((r for r in rows if r[1] == s), key=lambda r: hashlib.md5(f"7:{'null' if r[0] is None else r[0]}".encode()).hexdigest()):
            part = max(0, min(size(text), left))
            left -= size(text)
            more = [text] if part and 2 * part >= size(text) else []
            out[doc] = [text] * whole + more
    return out


def best_score(own, segment):
    """Score of the best segmentation, by trying every piece at every place."""
    index = {own.texts[i]: own.scores[i] for i in own.ids}
    best = [0.0] + [-1e18] * len(segment)
    for end in range(1, len(segment) + 1):
        best[end] = best[end - 1] + own.unknown
        for start in range(max(0, end - own.longest), end):
            best[end] = max(best[end], best[start] + index.get(segment[start:end], -1e18))
    return best[-1]
