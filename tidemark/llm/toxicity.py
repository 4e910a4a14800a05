"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; each model sees the words' features and the
probabilities of the categories before it.  In training those are predicted out of fold, so a
later model meets probabilities as good as it will meet in use.  The fit takes a
bounded sample of labelled rows; scoring covers every document and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import slices
from tidemark.llm.linking import arrays, list_column
from tidemark.llm.textkit import word_hashes

#: Labelled rows that the fit takes, those whose doc_id has the smallest hash.
FIT_ROWS = 12_000
#: Distinct words of a row that the fit takes, those of the smallest hashes; scoring takes all.
FIT_WORDS = 20_000
#: Words that become features: the most telling, each in this many of the rows at least.
FEATURES = 256
LEAST_ROWS = 4
#: What a word's log likelihood ratio must have beyond the logarithm of the number of words tried.
CHANCE = 4.0
FOLDS = 4
RIDGE = 1.0
ROUNDS = 12
#: Probability from which a document counts as being of a category.
THRESHOLD = 0.5


_STYLE = 4
#: Letters and digits stay, other ASCII becomes blank; bytes of other characters stay.
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def categories() -> dict[str, Column]:
    """Columns of the labels table in chain order: low quality tells something of what is toxic."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words, and four numbers of style."""
    words = word_hashes(text.lower().encode().translate(_WORDS))
    distinct = np.unique(words)
    n = len(words)
    raw = text.encode()
    plain = len(raw.translate(None, b"#*$%&|<>"))
    style = (np.log1p(n), len(distinct) / n if n else 0.0, (len(raw) - plain) / max(1, n), len(raw) / max(1, n))
    return distinct, np.array(style, dtype=np.float64)


@dataclass
class Chain:
    """Feature words in ascending order, the scale of the style numbers, and a weight vector for each category."""

    names: list[str]
    words: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]

    def base(self, words: np.ndarray, style: np.ndarray) -> np.ndarray:
        row = np.zeros(1 + _STYLE + len(self.words))
        row[0] = 1.0
        row[1 : 1 + _STYLE] = (style - self.centre) / self.spread
        if len(self.words) and len(words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            row[1 + _STYLE + at[self.words[at] == words]] = 1.0
        return row

    def probabilities(self, words: np.ndarray, style: np.ndarray) -> list[float]:
        row, found = self.base(words, style), []
        for w in self.weights:
            found.append(float(_sigmoid(row @ w)))
            row = np.append(row, _logit(found[-1]))
        return found


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Logistic regression with a ridge on all but the intercept, by Newton steps."""
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        p = _sigmoid(x @ w)
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x
        curve[np.diag_indices_from(curve)] += penalty
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.max(np.abs(step)) < 1e-5:
            break
    return w


def telling_words(rows: list[np.ndarray], labels: np.ndarray, most: int = FEATURES) -> np.ndarray:
    """The words whose presence tells most of any category: by the likelihood ratio of their counts."""
    flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.uint64)
    words, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    best = np.zeros(len(words))
    total = len(rows)
    for c in range(labels.shape[1]):
        y = labels[:, c]
        rate = min(max(y.mean(), 1e-6), 1 - 1e-6) if total else 0.5
        hit = np.bincount(inverse, weights=y[owner], minlength=len(words))
        p = (hit + rate) / (count + 1)
        gain = hit * np.log(p / rate) + (count - hit) * np.log((1 - p) / (1 - rate))
        best = np.maximum(best, gain)
    keep = np.flatnonzero(count >= LEAST_ROWS)
    # Of so many words, some pair up with a label by chance: their gains stay below the logarithm of their number.
    keep = keep[best[keep] >= np.log(max(1, len(keep))) + CHANCE]
    top = keep[np.lexsort((words[keep], -best[keep]))[:most]]
    return np.sort(words[top])


def fit_arrays(names: list[str], rows: list[np.ndarray], style: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> Chain:
    """The chain for rows of word hashes, style numbers and 0/1 labels; folds: 0 .. FOLDS - 1 of each row.

    In each fold the words are chosen, the style is scaled and the models are fit without the fold's rows: the
    probabilities that later models are trained on depend on no label of the row that they are for.
    """
    chain = _chain_of(names, rows, style, labels)
    if not len(rows):
        chain.weights = [np.zeros(1 + _STYLE + c) for c in range(len(names))]
        return chain
    asides = np.zeros((len(rows), 0))
    parts = []
    for k in range(FOLDS):
        out = folds == k
        held = [r for r, o in zip(rows, out, strict=True) if not o]
        inner = _chain_of(names, held, style[~out], labels[~out]) if held else chain
        parts.append((out, inner, _matrix(inner, rows, style)))
    x = _matrix(chain, rows, style)
    for c in range(len(names)):
        y = labels[:, c]
        chain.weights.append(fit_linear(np.column_stack([x, _logit(asides)]), y))
        if c + 1 == len(names):
            break
        aside = np.empty(len(y))
        for out, _, base in parts:
            both = np.column_stack([base, _logit(asides)])
            w = fit_linear(both[~out], y[~out]) if (~out).any() else np.zeros(both.shape[1])
            aside[out] = _sigmoid(both[out] @ w)
        asides = np.column_stack([asides, aside])
    return chain


def _chain_of(names: list[str], rows: list[np.ndarray], style: np.ndarray, labels: np.ndarray) -> Chain:
    """A chain without weights: the words and scales that these rows give."""
    chain = Chain(names, telling_words(rows, labels), np.zeros(_STYLE), np.ones(_STYLE), [])
    if len(rows):
        chain.centre, chain.spread = style.mean(axis=0), np.maximum(style.std(axis=0), 1e-6)
    return chain


def _matrix(chain: Chain, rows: list[np.ndarray], style: np.ndarray) -> np.ndarray:
    return np.stack([chain.base(r, s) for r, s in zip(rows, style, strict=True)])


def fit_chain(docs: DataFrame, labels: DataFrame, wanted: dict[str, Column] | None = None, most_rows: int = FIT_ROWS) -> Chain:
    """A chain for the wanted columns of labels, fit on most_rows labelled documents at most.

    Rows with a null doc_id, label or text aren't used.  The sample is the rows whose doc_id has the smallest
    hash, so it is the same in each run; its features, not its texts, go to the driver.
    """
    wanted = wanted or categories()
    names = list(wanted)
    marks = labels.select(
        F.col("doc_id").cast("long").alias("l_id"), *(v.cast("int").alias(f"y{i}") for i, v in enumerate(wanted.values()))
    ).dropna()
    sample = marks.orderBy(F.xxhash64("l_id"), "l_id", *(f"y{i}" for i in range(len(names)))).limit(most_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    picked = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).select(
        "doc_id", "text", F.array(*(f"y{i}" for i in range(len(names)))).alias("y")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("y"),
                    list_column([w[:FIT_WORDS] for w, _ in both]),
                    pa.array([s.tolist() for _, s in both], type=pa.list_(pa.float64())),
                ],
                names=["doc_id", "y", "words", "style"],
            )

    schema = "doc_id long, y array<int>, words array<bigint>, style array<double>"
    got = picked.mapInArrow(digest, schema).toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return fit_arrays(names, [], np.zeros((0, _STYLE)), np.zeros((0, len(names))), np.zeros(0, dtype=np.int64))
    column = lambda c: got.column(c).chunk(0)
    words = [w.view(np.uint64) for w in arrays(column("words"))]
    style = np.stack(list(arrays(column("style"))))
    y = np.stack(list(arrays(column("y")))).astype(np.float64)
    return fit_arrays(names, words, style, y, np.arange(len(words)) % FOLDS)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_<category> ..., is_<category> ...) for each row of docs.

    A null text is scored as an empty one.  doc_id may be null or repeat; each row is scored by itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{n}" for n in chain.names]
    schema = ", ".join(["doc_id long", *(f"{n} double" for n in names)])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            found = [model.probabilities(*features(t or "")) for t in batch.column("text").to_pylist()]
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(c, type=pa.float64()) for c in columns)], names=["doc_id", *names]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(predict, schema)
    return scored.select("*", *((F.col(f"p_{n}") >= threshold).alias(f"is_{n}") for n in chain.names))
