"""Language ID by a small convolutional network over bytes.

Byte embeddings, filters of several widths, the maximum over positions, and a softmax. It is
trained in numpy on a bounded sample of labelled windows and applied to the whole of every text,
cut into windows of ``WINDOW`` bytes; a text's scores are the mean of its windows' log
probabilities.

Defined cases
-------------
* ``und`` with score 0 for null texts, texts without a letter, and where no label was learned.
* The last window of a text is filled with zero bytes. Long texts are taken whole, in blocks of windows.
* Repeated rows repeat their results; a null id is kept. Further columns are ignored.
* An empty table gives no rows.

The sample bounds rows, never languages: about ``SAMPLE`` documents shared out evenly among all
languages, at most ``MOST`` and at least ``LEAST`` of each, chosen by a hash of the id, ``SNIPPETS``
windows each. Scoring is a narrow pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, crc32_mod

WINDOW = 128
SAMPLE = 12_000
MOST, LEAST = 1200, 30
SNIPPETS = 4
WIDTHS = (2, 3, 4)
#: Filters of each width; as many as there are languages, if that is more, up to ``WIDEST``.
PER_WIDTH, WIDEST = 10, 48
EMBED = 8
UNDETERMINED = "und"
SCHEMA = "doc_id long, lang_pred string, score double"
#: A letter is a character of the categories L; numbers like ½ and ② are none.
_LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteCnn:
    """``embed`` (256, e); ``filters`` (max width * e, f), zero beyond a filter's own width; ``out`` (f, classes)."""

    labels: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """Each position's run of embeddings: (n, positions, width * e)."""
        x = self.embed[windows]
        n, t, e = x.shape
        w = self.filters.shape[0] // e
        s = x.strides
        view = np.lib.stride_tricks.as_strided(x, (n, t - w + 1, w * e), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view)

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        cols = self._columns(windows)
        act = (cols.reshape(-1, cols.shape[2]) @ self.filters).reshape(cols.shape[0], cols.shape[1], -1)
        top = act.max(axis=1)
        hidden = np.maximum(top + self.bias, 0)
        logits = hidden @ self.out + self.out_bias
        return cols, act, hidden, logits

    def log_probs(self, windows: np.ndarray, block: int = 512) -> np.ndarray:
        parts = []
        for i in range(0, len(windows), block):
            logits = self.forward(windows[i : i + block])[3]
            logits = logits - logits.max(axis=1, keepdims=True)
            parts.append(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))
        return np.concatenate(parts)


def train(windows: np.ndarray, target: np.ndarray, labels: list[str], steps: int = 600, batch: int = 128, rate: float = 0.01, seed: int = 7) -> ByteCnn:
    """Adam on the cross entropy; classes are drawn evenly."""
    rng = np.random.default_rng(seed)
    per_width = min(max(PER_WIDTH, len(labels)), WIDEST)
    n_filters, widest = len(WIDTHS) * per_width, max(WIDTHS)
    mask = np.zeros((widest * EMBED, n_filters), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[: w * EMBED, i * per_width : (i + 1) * per_width] = 1
    p = [
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        rng.normal(0, 0.3, mask.shape).astype(np.float32) * mask,
        np.zeros(n_filters, np.float32),
        rng.normal(0, 0.2, (n_filters, len(labels))).astype(np.float32),
        np.zeros(len(labels), np.float32),
    ]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    by_class = [np.flatnonzero(target == c) for c in range(len(labels))]
    for step in range(1, steps + 1):
        picks = np.concatenate([rng.choice(ix, max(1, batch // len(labels))) for ix in by_class])
        model = ByteCnn(labels, *p)
        x, y = windows[picks], target[picks]
        cols, act, hidden, logits = model.forward(x)
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        d = prob
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        d_hidden = (d @ p[3].T) * (hidden > 0)
        where = act.argmax(axis=1)  # (n, filters): the position that the maximum took
        at = cols[np.arange(len(y))[:, None], where]  # (n, filters, width * e)
        g_filters = np.einsum("nf,nfk->kf", d_hidden, at) * mask
        d_at = d_hidden[:, :, None] * p[1].T[None]
        g_embed = np.zeros_like(p[0])
        for k in range(widest):
            bytes_there = x[np.arange(len(y))[:, None], where + k]
            np.add.at(g_embed, bytes_there, d_at[:, :, k * EMBED : (k + 1) * EMBED])
        for i, g in enumerate((g_embed, g_filters, d_hidden.sum(0), hidden.T @ d, d.sum(0))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = (p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteCnn(labels, *p)


def windows_of(raw: bytes) -> np.ndarray:
    """The text's bytes as rows of ``WINDOW``, the last one filled with zeros; one row at least."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def training_sample(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, bytes]]:
    """(language, window) of a bounded sample of the labelled rows; every language of theirs is in it."""
    docs = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return []
    each = max(LEAST, min(MOST, sample // languages))
    scale = 1 << 30
    share = F.least(F.lit(scale), F.ceil(F.lit(scale) / F.col("n") * each))
    picked = docs.join(broadcast_if_small(counts), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(scale)) < share)
    length = F.length("text")
    spots = F.transform(F.sequence(F.lit(0), F.lit(SNIPPETS - 1)), lambda i: F.substring(F.col("text"), F.floor(i * length / SNIPPETS).cast("int") + 1, F.lit(WINDOW)))
    rows = picked.select("lang", spots.alias("spots")).limit(2 * each * languages).collect()
    return [(r[0], s.encode("utf-8", "surrogatepass")[:WINDOW]) for r in rows for s in dict.fromkeys(r[1]) if _LETTER.search(s)]


def fit(docs: DataFrame) -> ByteCnn | None:
    """The network, or None where there is nothing to learn from."""
    sample = sorted(training_sample(docs))
    labels = sorted({lang for lang, _ in sample})
    if not labels:
        return None
    index = {lang: i for i, lang in enumerate(labels)}
    return train(np.concatenate([windows_of(w) for _, w in sample]), np.array([index[lang] for lang, _ in sample]), labels)


def predict(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every whole text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))
    block = 16_384  # windows, 2 MB of text, that are scored at a time

    def scored(texts: list[str | None]):
        """Mean log probabilities of each text; texts are gathered into blocks, long ones cut across them."""
        total = np.zeros((len(texts), len(model.labels)))
        count = np.zeros(len(texts))
        held, owner, n = [], [], 0

        def flush():
            nonlocal held, owner, n
            if held:
                lp = model.log_probs(np.concatenate(held))
                np.add.at(total, np.concatenate(owner), lp)
            held, owner, n = [], [], 0

        for i, text in enumerate(texts):
            if text is None or not _LETTER.search(text):
                continue
            rows = windows_of(text.encode("utf-8", "surrogatepass"))
            count[i] = len(rows)
            for a in range(0, len(rows), block):
                part = rows[a : a + block]
                held.append(part)
                owner.append(np.full(len(part), i))
                n += len(part)
                if n >= block:
                    flush()
        flush()
        return total / np.maximum(count, 1)[:, None], count > 0

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if model is None:
                langs, scores = [UNDETERMINED] * len(ids), [0.0] * len(ids)
            else:
                mean, has = scored(texts)
                best = mean.argmax(axis=1)
                prob = np.exp(mean - mean.max(axis=1, keepdims=True))
                prob /= prob.sum(axis=1, keepdims=True)
                langs = [model.labels[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)]
                scores = [float(prob[i, b]) if has[i] else 0.0 for i, b in enumerate(best)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def language_report(docs: DataFrame) -> DataFrame:
    """Learns from the rows whose crc32 of the id modulo 3 is not 1 and predicts every row."""
    model = fit(docs.where(crc32_mod("doc_id", 3) != 1))
    held = F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
