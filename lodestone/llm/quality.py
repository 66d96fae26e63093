"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's potential is a sum of weights of its own features and
of its two neighbours' (shares of capitals, signs, digits, repeated words and the like, in
bins), and neighbouring labels have a potential of their own. The forward-backward
algorithm gives each line's marginal; their mean, weighted by line length, is the score.

The field is fitted on at most ``SAMPLE`` labelled documents of each label, drawn by a hash
of their ids among those that are not held out; a document's label is its lines' label. Long
documents give several chains of ``CHAIN`` lines, of which again ``SAMPLE`` by label are drawn,
so what reaches the driver is bounded and no document is left out for its length.
Scoring is one pass over all texts, batch by batch, with the few hundred weights in the task.

Defined cases: null text is the empty text; an empty text is one empty line; blank lines
have no weight in the score; without labels of both kinds every score is the share of
label 1 among the labels, 0.5 without any; repeated rows are scored alike; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled documents, and most chains of lines, fitted on for each label; lines in a chain
#: (60 bytes each: at most 2 * SAMPLE * CHAIN * 60 bytes, 46 MB, reach the driver).
SAMPLE, CHAIN = 1500, 256
#: Characters worked on at once.
BLOCK_CHARS = 2_000_000
BINS, STEPS, RATE, DECAY = 8, 150, 0.1, 1e-4

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _PIPE, _BANG, _SIGN = range(8)


def _classes() -> np.ndarray:
    table = np.full(256, _SIGN, np.uint8)
    table[128:] = _LOWER
    for chars, kind in (
        (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"0123456789", _DIGIT),
        (b" \t\n\x0b\x0c\r", _SPACE), (b".,;:'\"-()?", _STOP), (b"|", _PIPE), (b"!", _BANG),
    ):
        table[list(chars)] = kind
    return table


CLASSES = _classes()
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
N_FEATURES = 15


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of all texts: features, byte lengths; and the number of lines of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    text_ends = np.cumsum([len(r) + 1 for r in raw]) - 1
    counts = np.diff(np.concatenate(([0], np.searchsorted(ends, text_ends) + 1)))
    doc = np.repeat(np.arange(len(raw)), counts)
    kind = CLASSES[buf]
    high = np.flatnonzero(buf == 0xC3)
    high = high[(buf[high + 1] >= 0x80) & (buf[high + 1] <= 0x9E)]
    kind[high] = _UPPER  # capitals of Latin-1
    n = len(starts)
    per = [np.add.reduceat((kind == k), starts, dtype=np.int64).astype(np.float64) for k in range(8)]
    size = (ends - starts).astype(np.float64)
    space = kind == _SPACE
    first = ~space
    first[1:] &= space[:-1]
    word_at = np.flatnonzero(first)
    word_line = np.searchsorted(ends, word_at)
    words = np.bincount(word_line, minlength=n).astype(np.float64)
    repeats, same_line = np.zeros(n), np.zeros(n)
    line_hash = np.zeros(n, np.uint64)
    if len(word_at):
        at = np.zeros(len(buf), np.int64)
        at[word_at] = word_at
        at = np.arange(len(buf)) - np.maximum.accumulate(at)
        value = np.where(space, 0, (buf.astype(np.uint64) + np.uint64(1)) * _POWERS[at & 63])
        hashes = np.add.reduceat(value, word_at)
        again = np.zeros(len(word_at), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (word_line[1:] == word_line[:-1])
        repeats = np.bincount(word_line[again], minlength=n).astype(np.float64)
        with np.errstate(over="ignore"):
            mixed = hashes * _POWERS[(np.arange(len(word_at)) - np.searchsorted(word_line, word_line)) & 63]
        edges = np.flatnonzero(np.diff(np.concatenate(([-1], word_line))))
        line_hash[word_line[edges]] = np.add.reduceat(mixed, edges)
        order = np.lexsort((line_hash, doc))
        twin = np.zeros(n, bool)
        twin[1:] = (doc[order][1:] == doc[order][:-1]) & (line_hash[order][1:] == line_hash[order][:-1])
        same_line[order] = twin
        same_line[words == 0] = 0
    some = np.maximum(size, 1)
    letters = per[_UPPER] + per[_LOWER]
    last = buf[np.maximum(ends - 1, 0)]
    here = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.stack(
        [
            np.log1p(size), per[_UPPER] / np.maximum(letters, 1), per[_SIGN] / some, per[_DIGIT] / some,
            per[_STOP] / some, per[_PIPE] / some, per[_BANG] / some, (some - per[_SPACE]) / np.maximum(words, 1),
            repeats / np.maximum(words, 1), same_line, np.log1p(words), (last == 46).astype(float),
            (kind[starts] == _LOWER).astype(float), (here == 0).astype(float), (here == np.repeat(counts, counts) - 1).astype(float),
        ],
        axis=1,
    )
    return out, np.where(words > 0, size, 0), counts


@dataclass
class Field:
    """Bin edges per feature, weights ``(neighbour, feature, bin)`` and label-pair potentials."""

    edges: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray
    constant: float | None = None

    def bins(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Index into the weights of each line's features, of its own and its neighbours'; bin 0: no neighbour."""
        own = np.stack([1 + np.searchsorted(self.edges[f], features[:, f]) for f in range(N_FEATURES)], axis=1)
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:], after[:-1] = own[:-1], own[1:]
        stop = np.cumsum(counts)
        before[stop - counts], after[stop - 1] = 0, 0
        shift = np.arange(N_FEATURES) * BINS
        wide = N_FEATURES * BINS
        return np.concatenate([own + shift, before + shift + wide, after + shift + 2 * wide], axis=1)


def forward_backward(odds: np.ndarray, counts: np.ndarray, pairs: np.ndarray):
    """Marginal of label 1 per line, expected label pairs summed, and the log of the norm summed.

    ``odds``: potential of label 1 over label 0 per line. All chains advance together,
    longest first, so each step is one operation over the chains that still go on.
    """
    start = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    start, length = start[order], counts[order]
    longest = int(length[0]) if len(length) else 0
    alive = [int(np.searchsorted(-length, -t, side="left")) for t in range(longest)]
    ahead = np.zeros((len(odds), 2))
    back = np.zeros((len(odds), 2))
    scale = np.zeros(len(odds))
    unary = np.stack([np.zeros(len(odds)), odds], axis=1)
    for t in range(longest):
        at = start[: alive[t]] + t
        if t == 0:
            a = unary[at]
        else:
            before = ahead[at - 1]
            a = unary[at] + np.logaddexp(before[:, :1] + pairs[0], before[:, 1:] + pairs[1])
        scale[at] = np.logaddexp(a[:, 0], a[:, 1])
        ahead[at] = a - scale[at][:, None]
    for t in range(longest - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        follow = back[at + 1] + unary[at + 1]
        b = np.logaddexp(pairs[:, 0] + follow[:, :1], pairs[:, 1] + follow[:, 1:])
        back[at] = b - scale[at + 1][:, None]
    both = ahead + back
    marginal = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    inner = np.ones(len(odds), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    joint = ahead[at - 1][:, :, None] + pairs + (unary[at] + back[at] - scale[at][:, None])[:, None, :]
    return marginal, np.exp(joint).sum(axis=0), scale.sum()


def fit(features: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Field:
    """Maximum conditional likelihood by Adam; each document weighs as one."""
    if len(labels) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.5
        return Field(np.zeros((N_FEATURES, BINS - 2)), np.zeros(3 * N_FEATURES * BINS), np.zeros((2, 2)), share)
    cuts = np.linspace(0, 1, BINS)[1:-1]
    field = Field(
        np.stack([np.quantile(features[:, f], cuts) for f in range(N_FEATURES)]), np.zeros(3 * N_FEATURES * BINS), np.zeros((2, 2))
    )
    index = field.bins(features, counts)
    y = np.repeat(labels, counts).astype(float)
    # Pairs of equal documents' lines: all (1, 1) or all (0, 0).
    seen = np.diag([float((counts[labels == k] - 1).sum()) for k in (0, 1)])
    theta = np.zeros(len(field.weights) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    lines = len(y)
    for step in range(1, STEPS + 1):
        field.weights, field.pairs = theta[:-4], theta[-4:].reshape(2, 2)
        marginal, pairs, _ = forward_backward(field.weights[index].sum(axis=1), counts, field.pairs)
        grad = np.bincount(index.ravel(), np.repeat(y - marginal, index.shape[1]), len(field.weights))
        g = np.concatenate([grad, (seen - pairs).ravel()]) / lines - DECAY * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field.weights, field.pairs = theta[:-4].copy(), theta[-4:].reshape(2, 2).copy()
    return field


def score_texts(field: Field, texts: list[str]) -> np.ndarray:
    if field.constant is not None or not texts:
        return np.full(len(texts), field.constant or 0.0)
    features, size, counts = line_features(texts)
    marginal, _, _ = forward_backward(field.weights[field.bins(features, counts)].sum(axis=1), counts, field.pairs)
    at = np.cumsum(counts) - counts
    total = np.add.reduceat(size, at)
    weighted = np.add.reduceat(size * marginal, at)
    plain = np.add.reduceat(marginal, at) / counts
    return np.clip(np.where(total > 0, weighted / np.maximum(total, 1), plain), 0.0, 1.0)


def _blocks(values: pa.Array) -> Iterator[list[str]]:
    texts: list[str] = []
    held = 0
    for value in values:
        texts.append(value.as_py() or "")
        held += len(texts[-1])
        if held >= BLOCK_CHARS:
            yield texts
            texts, held = [], 0
    if texts:
        yield texts


def held_out(id_column: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``label, id, at, features`` of each chain of a document's lines."""
    for batch in batches:
        for label, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            features, _, _ = line_features([text.as_py() or ""])
            for at in range(0, len(features), CHAIN):
                chain = pa.array([features[at : at + CHAIN].astype("<f4").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(label)], pa.int32()), pa.array([key], pa.string()), pa.array([at], pa.int32()), chain], ["label", "id", "at", "features"]
                )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Field:
    """Fit on labelled documents outside of the held-out fold, ``sample`` of each label at most."""
    usable = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id is not null and label in (0, 1)")
        .where(~held_out(F.col("id")))
        .groupBy("id").agg(F.max("label").alias("label"))
    )
    drawn = None
    for k in (0, 1):
        own = usable.where(F.col("label") == k).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample)
        drawn = own if drawn is None else drawn.unionByName(own)
    chains = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(drawn), "id")  # 2 * sample rows at most
        .select("label", F.col("id").cast("string").alias("id"), "text")
        .mapInArrow(_sampled, "label int, id string, at int, features binary")
    )
    order = [F.xxhash64("id", "at"), "id", "at", "features"]
    rows = [r for k in (0, 1) for r in chains.where(F.col("label") == k).orderBy(*order).limit(sample).collect()]
    parts = [np.frombuffer(r["features"], "<f4").reshape(-1, N_FEATURES).astype(float) for r in rows]
    counts = np.array([len(p) for p in parts], np.int64)
    return fit(np.concatenate(parts) if parts else np.zeros((0, N_FEATURES)), counts, np.array([r["label"] for r in rows], np.int64))


def quality_scores(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score_texts(field, texts) for texts in _blocks(batch.column(1))]
            out = pa.array(np.concatenate(scores) if scores else [], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
