"""License scans by template markup.

A template is wording with two kinds of markup: ``[[...]]`` is optional and ``{{name:n}}`` may be
replaced by one to ``n`` words. Each template is compiled into a token automaton: a state per
position, an edge that eats one given word, skips over optional regions, and bounded loops for
replaceable ones. A text is accepted where its words run through the mandatory wording exactly;
where it is altered, the score tells how far the best run came.

Words are maximal runs of a-z, 0-9 and code points beyond 127 after lower-casing A-Z. Beside the
templates, four fixed phrases are located wherever their words stand consecutively; their labels
always stay in the result.

Defined cases
-------------
* The score is the largest share of a template's mandatory words that one run eats (1: accepted), and
  0.5 at least where a phrase stands.
* Null text counts as empty: no words, no labels, null places, score 0.
* Repeated rows give repeated results; long texts are scanned whole. A template is tried only where
  its rarest-looking words (``needle``) stand in the text, and there at each of its first words once.
* Further columns are ignored. An empty table gives no rows.

One narrow pass in Arrow batches: no shuffle, memory of a batch.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .license_texts import PHRASES, TEMPLATES

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double, places array<struct<label:string,start:int,end:int>>"
)

_TO_SPACE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARKUP = re.compile(r"\[\[|\]\]|\{\{\w+:(\d+)\}\}|\||[^\s\[\]{}|]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()


class TokenAutomaton:
    """States 0..n; ``step[s]`` lists (word or None for any, next state), ``skip[s]`` the states reachable for free.

    ``eaten[s]`` is the number of mandatory words on the way to a state. ``needle`` is the beginning
    of the longest stretch of mandatory words: a text without it can't be accepted.
    """

    NEEDLE = 4

    def __init__(self, template: str):
        self.step: list[list[tuple[bytes | None, int]]] = [[]]
        self.skip: list[list[int]] = [[]]
        self.eaten = [0]
        self.runs: list[list[bytes]] = [[]]
        self.accept = self._region(list(_MARKUP.finditer(template)), 0, 0, 0)[1]
        self.reach = [self._closure(s) for s in range(len(self.step))]
        self.first = {w for s in self.reach[0] for w, _ in self.step[s] if w is not None}
        self.needle = b" ".join(max(self.runs, key=len)[: self.NEEDLE])

    def _state(self, eaten: int) -> int:
        self.step.append([])
        self.skip.append([])
        self.eaten.append(eaten)
        return len(self.step) - 1

    def _region(self, marks: list, i: int, at: int, depth: int) -> tuple[int, int]:
        """Compile from mark ``i`` and state ``at`` to the region's end; alternatives meet in one state."""
        begin, ends = at, []
        while i < len(marks):
            mark = marks[i].group()
            i += 1
            if mark == "]]":
                break
            if mark == "|":
                ends.append(at)
                at = begin
            elif mark == "[[":
                i, inner = self._region(marks, i, at, depth + 1)
                after = self._state(self.eaten[at])
                self.skip[at].append(after)
                self.skip[inner].append(after)
                at = after
                self.runs.append([])
            elif marks[i - 1].group(1):
                after = self._state(self.eaten[at])
                for _ in range(int(marks[i - 1].group(1))):
                    nxt = self._state(self.eaten[at])
                    self.step[at].append((None, nxt))
                    self.skip[nxt].append(after)
                    at = nxt
                at = after
                self.runs.append([])
            else:
                for word in words_of(mark):
                    nxt = self._state(self.eaten[at] + (depth == 0))
                    self.step[at].append((word, nxt))
                    at = nxt
                    if depth == 0:
                        self.runs[-1].append(word)
        if ends:
            after = self._state(self.eaten[begin])
            for e in (*ends, at):
                self.skip[e].append(after)
            at = after
        return i, at

    def _closure(self, state: int) -> frozenset[int]:
        todo, seen = [state], {state}
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def run(self, words: list[bytes], start: int) -> tuple[int | None, float]:
        """End of the longest accepted run that begins at ``start``, and the share of mandatory words that was eaten."""
        states, found, best = self.reach[0], None, 0
        for i in range(start, len(words) + 1):
            if self.accept in states:
                found = i
            if i == len(words):
                break
            word = words[i]
            met = [n for s in states for w, n in self.step[s] if w is None or w == word]
            if not met:
                break
            states = frozenset().union(*(self.reach[n] for n in met))
            best = max(best, max(self.eaten[n] for n in met))
        return found, 1.0 if found is not None else best / self.eaten[self.accept]


@lru_cache(maxsize=4)
def compiled(templates: tuple) -> tuple:
    return tuple((label, TokenAutomaton(t)) for label, t in templates)


def scan_words(words: list[bytes], templates: tuple = TEMPLATES) -> tuple[list, list, float]:
    """Places of the phrases, places of the templates, and the score of one text."""
    line = b" " + b" ".join(words) + b" "
    base = []
    for phrase, label in PHRASES.items():
        needle = b" " + phrase.encode() + b" "
        at, seen, word = line.find(needle), 0, 0
        while at >= 0:
            word += line.count(b" ", seen, at)
            seen = at
            base.append((word, label, phrase.count(" ") + 1))
            at = line.find(needle, at + 1)
    by_word: dict[bytes, list] = {}
    for label, a in compiled(templates):
        if b" " + a.needle + b" " in line:
            for w in a.first:
                by_word.setdefault(w, []).append((label, a))
    places, score = [], 0.5 if base else 0.0
    if by_word:
        for start, w in enumerate(words):
            for label, a in by_word.get(w, ()):
                end, share = a.run(words, start)
                score = max(score, share)
                if end is not None:
                    places.append((label, start, end))
    return base, places, score


def license_scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """One row per document with its labels, the places of phrases and of accepted templates, and a score."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))
    hints = {*(p.encode() for p in PHRASES), *(a.needle for _, a in compiled(templates))}
    hints = {max(h.split(), key=len) for h in hints}

    def scan(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                base, places, score = ([], [], 0.0) if hints.isdisjoint(words) else scan_words(words, templates)
                starts = [b[0] for b in base]
                base_labels = {b[1] for b in base}
                all_places = sorted({*((b[1], b[0], b[0] + b[2]) for b in base), *places}, key=lambda p: (p[1], p[0], p[2]))
                rows.append(
                    {
                        "doc_id": doc_id,
                        "n_words": len(words),
                        "n_base": len(base),
                        "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None),
                        "base_labels": ",".join(sorted(base_labels)),
                        "labels": ",".join(sorted(base_labels | {p[0] for p in places})),
                        "score": score,
                        "places": [{"label": a, "start": b, "end": c} for a, b, c in all_places],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(scan, SCHEMA)
