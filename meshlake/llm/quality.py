"""Quality classifier: a sparse ensemble of rules.

Statistics of each text are computed in one narrow pass. On a bounded sample of labelled rows,
small trees are grown on random halves; every path from a root, to inner nodes too, is a rule: a
conjunction of comparisons on statistics. A logistic regression with an L1 penalty weighs the
rules and drops most of them; what is left is compiled into one Spark column expression.

Defined cases
-------------
* Null and empty texts have statistics of zero and get a score like any other.
* Without labels of both kinds, the score of every text is the share of label 1 (0.5 if there is none).
* A row whose id is null is neither learned from nor held out; it is scored. Several labels of one
  id: the largest quality. Repeated rows repeat their results. Further columns are ignored.
* Empty tables give no rows. Texts are taken whole.

The sample is at most ``SAMPLE`` rows, chosen by a hash of the id, whatever the size of the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod

SAMPLE = 20_000
TREES = 40
DEPTH = 3
PENALTY = 0.002
#: Score from which a text is taken as good.
KEEP = 0.3

STATISTICS = (
    "n_chars", "n_words", "n_lines", "word_length", "longest_word", "upper_share", "digit_share",
    "symbol_share", "ending_share", "comma_share", "bar_share", "bang_share", "distinct_words",
    "distinct_lines", "capital_words", "top_word_share", "glued_symbols",
)
SCHEMA = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)

_UPPER, _DIGITS = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGITS[48:58] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*^|~"]] = True


def statistics(text: str | None) -> list[float]:
    """The text's numbers, in the order of ``STATISTICS``."""
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    lines = [x for x in text.split("\n") if x]
    distinct: dict[str, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    lengths = [*map(len, distinct)]
    return [
        float(len(text)),
        float(len(words)),
        float(len(lines)),
        len(text) / n,
        float(max(lengths, default=0)),
        counts[_UPPER].sum() / size,
        counts[_DIGITS].sum() / size,
        counts[_SYMBOLS].sum() / size,
        (counts[46] + counts[33] + counts[63]) / n,
        counts[44] / n,
        counts[124] / n,
        text.count("!!") / n,
        len(distinct) / n,
        len(set(lines)) / max(1, len(lines)),
        sum(c for w, c in distinct.items() if w[0].isupper()) / n,
        max(distinct.values(), default=0) / n,
        sum(c for w, c in distinct.items() if w[-1] in "#$%&*") / n,
    ]


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of every whole text."""

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            table = np.array(rows, np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(table[:, i])) for i in range(table.shape[1]))], names=["doc_id", *STATISTICS]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


# ---------------------------------------------------------------- learning, on the bounded sample
Condition = tuple[int, bool, float]  # statistic, greater than (else at most), threshold
Rule = frozenset


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, path: Rule, out: list[Rule]) -> None:
    """Split by Gini impurity on a random half of the statistics; each path is added to ``out``."""
    if path:
        out.append(path)
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return
    best = (0.0, -1, 0.0)
    whole = 2 * y.mean() * (1 - y.mean())
    for j in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
        order = np.argsort(x[:, j], kind="stable")
        v, t = x[order, j], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut >= 4) & (cut < len(v) - 5)]
        if not len(cut):
            continue
        left, total = cut + 1.0, float(len(v))
        p, q = t[cut] / left, (t[-1] - t[cut]) / (total - left)
        gain = whole - (left * 2 * p * (1 - p) + (total - left) * 2 * q * (1 - q)) / total
        k = int(gain.argmax())
        if gain[k] > best[0] + 1e-9:
            best = (float(gain[k]), int(j), float((v[cut[k]] + v[cut[k] + 1]) / 2))
    if best[1] < 0:
        return
    _, j, at = best
    above = x[:, j] > at
    for side, which in ((True, above), (False, ~above)):
        grow(x[which], y[which], rng, depth - 1, path | {(j, side, at)}, out)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > at) == side for j, side, at in rule])


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the intercept is not penalised."""
    n, k = a.shape
    full = np.hstack([a, np.ones((n, 1))])
    rate = 4.0 / max(np.linalg.eigvalsh(full.T @ full / n)[-1], 1e-9)
    w = np.zeros(k + 1)
    z, t = w.copy(), 1.0
    for _ in range(steps):
        g = full.T @ (1 / (1 + np.exp(-np.clip(full @ z, -30, 30))) - y) / n
        new = z - rate * g
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w[:k], float(w[k])


@dataclass
class RuleEnsemble:
    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self, prefix: str = "") -> Column:
        """The probability of label 1 as a column expression over the statistics, whose names begin with ``prefix``."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            every = F.lit(True)
            for j, side, at in sorted(rule):
                value = F.col(prefix + STATISTICS[j])
                every = every & ((value > at) if side else (value <= at))
            total = total + F.when(every, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def learn(x: np.ndarray, y: np.ndarray, seed: int = 11) -> RuleEnsemble:
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 0.5) / (len(y) + 1)
        return RuleEnsemble([], float(np.log(share / (1 - share))) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    found: list[Rule] = []
    for _ in range(TREES):
        half = rng.choice(len(y), min(len(y), max(20, len(y) // 2), 4000), replace=False)
        grow(x[half], y[half], rng, DEPTH, frozenset(), found)
    rules = sorted(set(found), key=sorted)
    a = np.column_stack([holds(r, x) for r in rules]).astype(np.float64) if rules else np.zeros((len(y), 0))
    weights, intercept = lasso_logistic(a, y.astype(np.float64), PENALTY)
    return RuleEnsemble([(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6], intercept)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of a bounded sample of the labelled rows."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = labels.count()
    scale = 1 << 30
    picked = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(scale)) < min(scale, -(-scale * sample * 9 // (10 * max(1, n)))))
    picked = picked.limit(sample).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    some = docs.join(F.broadcast(picked), "doc_id", "left_semi")
    rows = text_statistics(some).join(F.broadcast(picked), "doc_id").orderBy("doc_id").limit(2 * sample).toPandas()
    return rows[list(STATISTICS)].to_numpy(np.float64), rows["quality"].to_numpy(np.int64)


def fit(docs: DataFrame, labels: DataFrame) -> RuleEnsemble:
    return learn(*labelled_sample(docs, labels))


def score_documents(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text."""
    return text_statistics(docs).select("doc_id", model.score().alias("score")).withColumn("predicted", (F.col("score") >= KEEP).cast("int"))


def learn_fold(docs: DataFrame, labels: DataFrame) -> RuleEnsemble:
    """Learns from the rows whose crc32 of the id modulo 5 is not 0."""
    return fit(docs.where(crc32_mod("doc_id", 5) != 0), labels.where(crc32_mod("doc_id", 5) != 0))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn_fold(docs, labels)
    held = F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False))
    return score_documents(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected ones, all columns kept; the texts pass once, with the statistics beside them."""
    model = learn_fold(docs, labels)
    columns = docs.columns

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        table = np.array([statistics(t) for t in texts.to_pylist()], np.float64).reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(table))

    # Only the text goes to Python, and only its numbers come back.
    scored = docs.select(F.struct("*").alias("row"), measured("text").alias("numbers"))
    scored = scored.select("row", *(F.col("numbers")[i].alias(f"_quality_{s}") for i, s in enumerate(STATISTICS)))
    return scored.where(model.score("_quality_") >= KEEP).select(*(F.col(f"row.`{c}`").alias(c) for c in columns))
