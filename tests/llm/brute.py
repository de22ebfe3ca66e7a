"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

from tokenizers import Tokenizer

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# ---------------------------------------------------------------- Jaccard join
def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER)) if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < 3 else {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def jaccard_groups(rows):
    """(doc_id, n_shingles, component_id) of each (doc_id, text), comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)].append(doc_id)
    return [(d, len(s), (min(least[find(i)], default=None) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


# ---------------------------------------------------------------- decontamination
def plain_words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def overlaps(docs, items, span=11, flank=4):
    """(doc_id, item_id) -> words that agree on the best diagonal; docs and items are (id, text)."""
    first = {}
    for item, text in items:
        words = tuple(plain_words(text))
        if words:
            first[words] = item if first.get(words) is None else first[words] if item is None else min(first[words], item)

    def near(words, i):
        return tuple(words[j] if 0 <= j < len(words) else None for j in range(i - flank, i + span + flank))

    def masks(n):
        cells = [[j for j in range(n) if j % (n // 5 + 2) == c] for c in range(n // 5 + 2)]
        return [tuple(sorted(a + b)) for a, b in combinations(cells, 2)]

    # The same window of several items counts for the smallest.
    window = {}
    for words, item in first.items():
        n = min(span, len(words))
        for j in range(len(words) - n + 1):
            key, value = (n, near(words, j)), (item is None, item or 0, j, item, words)
            window[key] = min(window.get(key, value), value)
    seeds = defaultdict(set)
    for (n, seen), (_, _, j, item, words) in window.items():
        for mask in masks(n):
            seeds[n, mask, tuple(words[j + o] for o in mask)].add((item, words, j))
    sizes = {n for n, _ in window}
    out = {}
    for doc_id, text in docs:
        words = plain_words(text)
        starts = {(n, i) for n in sizes if n >= 5 for i in range(len(words) - n + 1)}
        at = 0
        for line in (text or "").split("\n"):
            n = len(plain_words(line))
            starts |= {(n, at)} if 0 < n < 5 else set()
            at += n
        starts |= {(at, 0)} if 0 < at < 5 else set()
        met = defaultdict(set)
        for n, i in starts:
            for mask in masks(n):
                for item, other, j in seeds.get((n, mask, tuple(words[i + o] for o in mask)), ()):
                    pairs = [(o, x == y) for o, x, y in zip(range(-flank, span + flank), near(words, i), near(other, j), strict=True) if None not in (x, y)]
                    inner = [s for o, s in pairs if 0 <= o < span]
                    if any(5 * sum(p) >= 4 * len(p) for p in ([s for _, s in pairs], inner)):
                        met[item, i - j] |= {j + o for o, s in pairs if s}
        for (item, _), places in met.items():
            out[doc_id, item] = max(out.get((doc_id, item), 0), len(places))
    return out


# ---------------------------------------------------------------- secrets
BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def base_secrets(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(found)


# ---------------------------------------------------------------- sentence spans
def removed_sentences(rows, sentences, least_sentences, least_words):
    """(doc_id, text) -> indexes of the sentences that a non-first repeated run covers; no hashing."""
    seen = defaultdict(list)
    for doc_id, text in dict.fromkeys(rows):
        parts = sentences(text or "")
        for i in range(len(parts)):
            end, words = i, 0
            while end < len(parts) and (end - i < least_sentences or words < least_words):
                words += parts[end][3]
                end += 1
            if end - i >= least_sentences and words >= least_words:
                seen[" ".join(p[2] for p in parts[i:end])].append((doc_id, i, end, text))
    gone = defaultdict(set)
    for places in seen.values():
        places.sort(key=lambda p: (p[0] is not None, p[0], p[3] if False else "", p[1]))
        for doc_id, i, end, text in places[1:]:
            gone[doc_id, text] |= set(range(i, end))
    return gone


# ---------------------------------------------------------------- tokens
def pieces(doc_id, text, path, capacity):
    ids = [*_tokenizer(path).encode(text or "", add_special_tokens=False).ids, 0]
    for piece, start in enumerate(range(0, len(ids), capacity)):
        part = ids[start : start + capacity]
        yield doc_id, piece, start, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))


_made = {}


def _tokenizer(path):
    if path not in _made:
        _made[path] = Tokenizer.from_file(path)
    return _made[path]


def packing_problems(rows, capacity):
    """Rows (doc_id, piece, start, length, crc, sequence_id, offset): what is wrong with the sequences."""
    by = defaultdict(list)
    for r in rows:
        by[r[5]].append((r[6], r[3]))
    wrong = []
    for name, parts in by.items():
        at = 0
        for offset, length in sorted(parts):
            if offset != at:
                wrong.append((name, offset, at))
            at = offset + length
        if at > capacity:
            wrong.append((name, at))
    return wrong, Counter(by.keys())


# ---------------------------------------------------------------- collocations
def collocations(rows, least=30, longest=4, top=2000):
    """rows of (lang, text) -> (lang, rank, phrase, a, l, r, n, score)."""
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                count[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in count.items():
        candidates = [p for p, a in f.items() if a >= least and len(p) > 1]
        covered = set()
        for p in candidates:
            covered |= {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * f[p] >= 80 * f[p[i:j]]}
        found = []
        for p in candidates:
            if p not in covered:
                score, k = min((2000000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return out


# ---------------------------------------------------------------- periodic runs
def runs(words):
    """(start, length, period) of all runs, by trying each period at each place."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            if i > s and e - s >= max(6, 4 * q) and not any(all(words[t] == words[t + p] for t in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    longest = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    s, length, q = longest[0] if longest else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return doc_id, len(found), s, length, q, 1000 * length // q if longest else None, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone))
