"""A convolutional text classifier for toxicity: hashed word embeddings, filters of several widths, max pooling.

A word's embedding is the mean of the vectors of its hash and of the hashes of its
grams, so unseen forms of known words have one too. Filters of one to three words
run over the whole text and the largest answer of each filter counts. The network
is trained in numpy on a bounded sample; its first dimension starts as the log-odds
of each hashed feature. A threshold is calibrated for each language, as guessed from
the words of the text, and the score is the distance from it.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm import hashing as H
from cohortry.llm.samples import class_sample

WIDTHS = (1, 2, 3)
CUT = 0.3


@dataclass
class Words:
    """Texts as places in a list of distinct words, and the hashed features of those words."""

    sequence: np.ndarray  # one place per word, two pads after each text
    at: np.ndarray  # places of the words in ``sequence``
    first: np.ndarray  # each text's first entry of ``at``
    features: np.ndarray
    pointer: np.ndarray
    hashes: np.ndarray

    @property
    def pad(self) -> int:
        return len(self.hashes)


def read_words(texts: pa.Array, grams: Sequence[int], buckets: int) -> Words:
    data, offsets = H.text_bytes(texts)
    hashes, first, starts = H.word_hashes(data, offsets, H.PLAIN)
    distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
    begin = starts[where]
    # A word ends at the next byte of another kind or at the next text.
    outside = np.r_[np.flatnonzero(H.PLAIN[data] == 0), len(data)]
    end = outside[np.searchsorted(outside, begin)]
    end = np.minimum(end, offsets[np.searchsorted(offsets, begin, side="right")]) if len(begin) else end
    parts = [(np.arange(len(distinct)), distinct), *H.gram_hashes(data, begin, end, tuple(grams), H.byte_values, True)]
    word = np.concatenate([x[0] for x in parts])
    feature = (np.concatenate([x[1] for x in parts]) >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(word, kind="stable")
    counts = np.diff(first)
    padded = np.maximum(counts, 1) + 2
    base = np.cumsum(padded) - padded
    sequence = np.full(int(padded.sum()), len(distinct), np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    spot = base[text] + np.arange(len(text)) - first[:-1][text]
    sequence[spot] = back
    windows = np.maximum(counts, 1)
    begin_windows = np.cumsum(windows) - windows
    at = np.arange(int(windows.sum())) - np.repeat(begin_windows, windows) + np.repeat(base, windows)
    return Words(sequence, at, begin_windows, feature[order].astype(np.int64),
                 np.r_[0, np.cumsum(np.bincount(word, minlength=len(distinct)))], distinct)


@dataclass
class ToxicityModel:
    embedding: np.ndarray
    filters: list[list[np.ndarray]]  # by width and place: dimensions x filters
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float
    languages: list[str]
    word_scores: np.ndarray  # buckets x languages, log frequencies
    thresholds: np.ndarray
    grams: tuple[int, ...]
    fitted: bool = True

    def word_vectors(self, words: Words) -> np.ndarray:
        """One row per distinct word and a zero row for pads."""
        rows = np.zeros((len(words.hashes) + 1, self.embedding.shape[1]), np.float32)
        counts = np.diff(words.pointer)
        step = 1 << 16
        for a in range(0, len(counts), step):
            lo, hi = words.pointer[a], words.pointer[min(len(counts), a + step)]
            part = np.add.reduceat(self.embedding[words.features[lo:hi]], words.pointer[a:a + step][:len(counts) - a] - lo)
            rows[a:a + len(part)] = part / counts[a:a + step, None]
        return rows

    def answers(self, vectors: np.ndarray, words: Words) -> list[np.ndarray]:
        """For each width, every filter's answer at every word."""
        out = []
        for width, parts in zip(WIDTHS, self.filters):
            total = None
            for j in range(width):
                piece = (vectors @ parts[j])[words.sequence[words.at + j]]
                total = piece if total is None else total + piece
            out.append(total)
        return out

    def logits(self, words: Words) -> np.ndarray:
        vectors = self.word_vectors(words)
        pooled = [np.maximum.reduceat(x, words.first) + b for x, b in zip(self.answers(vectors, words), self.bias)]
        return np.maximum(np.concatenate(pooled, axis=1), 0) @ self.out + self.shift

    def language(self, words: Words) -> np.ndarray:
        """The likeliest language of each text by its words."""
        table = np.vstack([self.word_scores[(words.hashes >> np.uint64(24)) % np.uint64(len(self.word_scores))],
                           np.zeros((1, len(self.languages)))])
        return np.add.reduceat(table[words.sequence[words.at]], words.first).argmax(axis=1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """From 0 to 1; ``CUT`` at the threshold of the text's language."""
        if not len(texts) or not self.fitted:
            return np.zeros(len(texts))
        words = read_words(texts, self.grams, len(self.embedding))
        far = np.clip(self.logits(words) - self.thresholds[self.language(words)], -50, 50)
        return 1 / (1 + np.exp(-far) * (1 - CUT) / CUT)


def _learn(model: ToxicityModel, texts: list, labels: np.ndarray, epochs: int, batch: int, rate: float, seed: int):
    """Adagrad on the log loss, both classes of equal weight."""
    draw = np.random.default_rng(seed)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    state: dict = {}

    def step(name, array, grad, rows=None):
        held = state.setdefault(name, np.zeros_like(array))
        if rows is None:
            held += grad * grad
            array -= rate * grad / (np.sqrt(held) + 1e-6)
        else:
            held[rows] += grad * grad
            array[rows] -= rate * grad / (np.sqrt(held[rows]) + 1e-6)

    for _ in range(epochs):
        order = draw.permutation(len(texts))
        for a in range(0, len(order), batch):
            chosen = order[a:a + batch]
            words = read_words(pa.array([texts[i] for i in chosen], pa.large_string()), model.grams, len(model.embedding))
            vectors = model.word_vectors(words)
            ends = np.r_[words.first[1:], len(words.at)]
            answers = model.answers(vectors, words)
            peaks = [np.stack([x[lo:hi].argmax(axis=0) + lo for lo, hi in zip(words.first, ends)]) for x in answers]
            pooled = [np.take_along_axis(x, p, 0) + b for x, p, b in zip(answers, peaks, model.bias)]
            hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
            z = hidden @ model.out + model.shift
            dz = ((1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            dh = dz[:, None] * model.out * (hidden > 0)
            d_vectors = np.zeros_like(vectors)
            at = 0
            for k, (width, peak) in enumerate(zip(WIDTHS, peaks)):
                n = peak.shape[1]
                part = dh[:, at:at + n]
                at += n
                for j in range(width):
                    place = words.sequence[words.at[peak] + j]
                    d_filter = np.einsum("bfd,bf->df", vectors[place], part)
                    np.add.at(d_vectors, place, part[:, :, None] * model.filters[k][j].T[None])
                    step(("filter", k, j), model.filters[k][j], d_filter)
                step(("bias", k), model.bias[k], part.sum(axis=0))
            step("out", model.out, hidden.T @ dz)
            model.shift -= rate * float(dz.sum())
            touched = np.flatnonzero(np.abs(d_vectors[:-1]).any(axis=1))
            if len(touched):
                sizes = np.diff(words.pointer)[touched]
                spots = np.repeat(words.pointer[touched] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                rows, back = np.unique(words.features[spots], return_inverse=True)
                grad = np.zeros((len(rows), vectors.shape[1]), np.float32)
                np.add.at(grad, back, np.repeat(d_vectors[touched] / sizes[:, None], sizes, axis=0))
                step("embedding", model.embedding, grad, rows)


def _threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap at which F1 is best."""
    order = np.argsort(-logits)
    z, y = logits[order], labels[order]
    hits = np.cumsum(y)
    best = int(np.argmax(2 * hits / (np.arange(1, len(y) + 1) + y.sum())))
    return float((z[best] + z[best + 1]) / 2 if best + 1 < len(z) else z[best] - 1.0)


def _fit(sample: pa.Table, dims: int, filters: int, buckets: int, grams: tuple[int, ...], epochs: int, batch: int,
         rate: float, seed: int) -> ToxicityModel:
    draw = np.random.default_rng(seed)
    texts, langs = sample.column("text").to_pylist(), [x or "" for x in sample.column("lang").to_pylist()]
    labels = np.array(sample.column("label").to_pylist(), np.float32)
    languages = sorted(set(langs)) or [""]
    embedding = (draw.standard_normal((buckets, dims)) * 0.05).astype(np.float32)
    model = ToxicityModel(
        embedding, [[(draw.standard_normal((dims, filters)) * 0.3).astype(np.float32) for _ in range(w)] for w in WIDTHS],
        [np.zeros(filters, np.float32) for _ in WIDTHS], (draw.standard_normal(len(WIDTHS) * filters) * 0.1).astype(np.float32),
        0.0, languages, np.zeros((1 << 15, len(languages)), np.float32), np.zeros(len(languages)), grams,
        fitted=0 < labels.sum() < len(labels))
    if not model.fitted:
        return model
    # A fifth of the sample is left for the thresholds.
    aside = np.arange(len(labels)) % 5 == 4
    if labels[aside].sum() == 0 or labels[~aside].sum() == 0:
        aside = np.zeros(len(labels), bool)
    with_, without, spoken = np.zeros(buckets), np.zeros(buckets), np.zeros(model.word_scores.shape)
    for i, text in enumerate(texts):
        words = read_words(pa.array([text], pa.large_string()), grams, buckets)
        np.add.at(spoken[:, languages.index(langs[i])],
                  (words.hashes >> np.uint64(24)) % np.uint64(len(spoken)), 1)
        if not aside[i]:
            seen = np.unique(words.features)
            (with_ if labels[i] else without)[seen] += 1
    ratio = labels[~aside].sum() / max(1, (labels[~aside] == 0).sum())
    embedding[:, 0] = np.log((with_ + 2 * ratio) / (without + 2) / ratio)
    spoken += 0.1
    model.word_scores = np.log(spoken / spoken.sum(axis=0)).astype(np.float32)
    for k, width in enumerate(WIDTHS):  # the first filter of each width starts as the sum of the log-odds
        for j in range(width):
            model.filters[k][j][:, 0] = np.eye(dims, dtype=np.float32)[0]
        model.out[k * filters] = 1.0 / width
    keep = np.flatnonzero(~aside)
    _learn(model, [texts[i] for i in keep], labels[keep], epochs, batch, rate, seed)
    judged = np.flatnonzero(aside) if aside.any() else keep
    logits, spoken_by = [], []
    for a in range(0, len(judged), 256):
        words = read_words(pa.array([texts[i] for i in judged[a:a + 256]], pa.large_string()), grams, buckets)
        logits.append(model.logits(words))
        spoken_by.append(model.language(words))
    logits, spoken_by, y = np.concatenate(logits), np.concatenate(spoken_by), labels[judged]
    common = _threshold(logits, y)
    for i in range(len(languages)):
        mine = spoken_by == i
        n = y[mine].sum()
        own = _threshold(logits[mine], y[mine]) if n else common
        model.thresholds[i] = (n * own + 5 * common) / (n + 5)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 4000, most_bytes: int = 100_000,
                 dims: int = 8, filters: int = 8, buckets: int = 1 << 18, grams: tuple[int, ...] = (4, 5, 6),
                 epochs: int = 3, batch: int = 32, rate: float = 0.05, seed: int = 11) -> ToxicityModel:
    """A model from at most ``per_label`` texts (of ``most_bytes`` at most) with label 1 and with label 0.

    Held-out rows, null labels and documents that are not in ``docs`` are not
    learned from. Without both labels the model gives every text 0.
    """
    sample = class_sample(docs, labels.select("doc_id", F.col("toxic").alias("label")), per_label, most_bytes)
    return _fit(sample, dims, filters, buckets, grams, epochs, batch, rate, seed)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``score`` and ``predicted`` (1 from ``CUT`` on).

    Only the text decides. Null and empty texts, and texts without a word, get
    the score of a text without any word.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    kept = [c for c in keep if c not in ("score", "predicted")]
    # The text travels once, also where it is one of the columns to keep.
    sent = [*kept, *(["text"] if "text" not in kept else [])]
    named = {c: f"c{i}" for i, c in enumerate(sent)}
    back = [named[c] for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in H.slices(batch, named["text"], 1 << 20):
                scores = shared.value.scores(piece.column(named["text"]))
                yield pa.record_batch(
                    [*[piece.column(c) for c in back], pa.array(scores, pa.float64()),
                     pa.array((scores >= CUT).astype(np.int32))], names=[*back, "score", "predicted"])

    rows = docs.select(*[F.col(c).alias(n) for c, n in named.items()])
    types = dict(rows.dtypes)
    out = rows.mapInArrow(run, ", ".join([*[f"{n} {types[n]}" for n in back], "score double", "predicted int"]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, back)], "score", "predicted")
