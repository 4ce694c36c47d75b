"""Language identification: known words first, shorter and shorter character grams for the others.

A word of the learned list scores its log frequency in each language. Another
word is cut into grams of characters, longest first; the first length of which
some gram is known gives the mean log frequency of those grams. A text's language is the
one with the largest sum over its words.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm import hashing as H
from cohortry.llm.samples import class_sample

UNKNOWN = "und"
GRAMS = (5, 4, 3, 2, 1)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def _values(points: np.ndarray) -> np.ndarray:
    return H.mixed(points.astype(np.uint64) + np.uint64(1)) | np.uint64(1)


@dataclass
class Letters:
    """The words of some texts: runs of letters in lower case."""

    points: np.ndarray
    distinct: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray  # of each word
    back: np.ndarray  # of each word, its place among the distinct ones


def read_letters(texts: pa.Array) -> Letters:
    lowered = [(x or "").lower() for x in texts.to_pylist()]
    offsets = np.r_[0, np.cumsum([len(x) for x in lowered])].astype(np.int64)
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    inside = _letter_table()[points]
    begins = H.run_begins(inside.astype(np.uint8), offsets)
    hashes, starts = H.run_hashes(points, inside, begins, _values)
    distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
    begin = starts[where]
    outside = np.r_[np.flatnonzero(~inside), len(points)]
    end = outside[np.searchsorted(outside, begin)]
    end = np.minimum(end, offsets[np.searchsorted(offsets, begin, side="right")]) if len(begin) else end
    return Letters(points, distinct, begin, end, np.searchsorted(offsets, starts, side="right") - 1, back)


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys in a sorted table, -1 where they are not."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class LanguageModel:
    languages: list[str]
    words: np.ndarray  # sorted hashes
    word_scores: np.ndarray  # log frequencies, words x languages
    grams: dict[int, tuple[np.ndarray, np.ndarray]]

    def word_vectors(self, letters: Letters) -> np.ndarray:
        """Log frequencies of each distinct word, by itself or by its grams."""
        out = np.zeros((len(letters.distinct), len(self.languages)))
        at = _lookup(self.words, letters.distinct)
        out[at >= 0] = self.word_scores[at[at >= 0]]
        rest = np.flatnonzero(at < 0)
        for n in GRAMS:
            if not len(rest):
                break
            (word, hashes), = H.gram_hashes(letters.points, letters.begin[rest], letters.end[rest], (n,), _values, n > 1)
            table, scores = self.grams[n]
            known = _lookup(table, hashes)
            word, known = word[known >= 0], known[known >= 0]
            count = np.bincount(word, minlength=len(rest))
            for k in range(len(self.languages)):
                total = np.bincount(word, scores[known, k], len(rest))
                out[rest, k] = np.where(count > 0, total / np.maximum(count, 1), 0)
            rest = rest[count == 0]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        letters = read_letters(texts)
        spoken = np.bincount(letters.text, minlength=len(texts)) > 0
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        vectors = self.word_vectors(letters)
        total = np.stack([np.bincount(letters.text, vectors[letters.back, k], len(texts))
                          for k in range(len(self.languages))], axis=1)
        far = np.exp(total - total.max(axis=1, keepdims=True))
        score = far.max(axis=1) / far.sum(axis=1)
        best = total.argmax(axis=1)
        return ([self.languages[b] if s else UNKNOWN for b, s in zip(best, spoken)], np.where(spoken, score, 0.0))


def _log_frequencies(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All keys, sorted, and their smoothed log frequency by language."""
    every, back = np.unique(np.concatenate(keys), return_inverse=True)
    table = np.zeros((len(every), len(keys)))
    lengths = np.cumsum([0, *map(len, keys)])
    for k, c in enumerate(counts):
        table[back[lengths[k]:lengths[k + 1]], k] = c
    total = table.sum(axis=0)
    return every, np.log((table + 0.5) / (total + 0.5 * len(every)))


def fit_languages(docs: DataFrame, per_language: int = 2000, most_bytes: int = 100_000, least_count: int = 2) -> LanguageModel:
    """A model from at most ``per_language`` texts (of ``most_bytes`` at most) of each ``lang``, held-out rows left out.

    All words and grams of these texts are kept, so a small language loses none to a large
    one; words that occur once are learned only through their grams. A language all of whose texts are
    longer than ``most_bytes`` is not learned. Repeated rows count once; an empty table gives a model that
    answers ``und``.
    """
    sample = class_sample(docs, F.col("lang"), per_language, most_bytes)
    labels = np.array(sample.column("label").to_pylist(), object)
    languages = sorted(set(labels))
    if not languages:
        empty = (np.zeros(0, np.uint64), np.zeros((0, 0)))
        return LanguageModel([], *empty, {n: empty for n in GRAMS})
    keys: dict[int, list] = {n: [] for n in (0, *GRAMS)}
    counts: dict[int, list] = {n: [] for n in (0, *GRAMS)}
    for language in languages:
        texts = pa.array([x for x, y in zip(sample.column("text").to_pylist(), labels) if y == language], pa.large_string())
        letters = read_letters(texts)
        times = np.bincount(letters.back, minlength=len(letters.distinct))
        often = times >= least_count
        keys[0].append(letters.distinct[often])
        counts[0].append(times[often])
        for n in GRAMS:
            (word, hashes), = H.gram_hashes(letters.points, letters.begin, letters.end, (n,), _values, n > 1)
            distinct, back = np.unique(hashes, return_inverse=True)
            keys[n].append(distinct)
            counts[n].append(np.bincount(back, times[word], len(distinct)))
    tables = {n: _log_frequencies(keys[n], counts[n]) for n in keys}
    return LanguageModel(languages, *tables[0], {n: tables[n] for n in GRAMS})


def identify_language(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row of ``docs``, from the text alone.

    ``und`` with score 0 where the text is null or has no letter. The score is the
    share of the predicted language. Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in H.slices(batch, "text"):
                found, score = shared.value.predict(piece.column("text"))
                yield pa.record_batch([piece.column("doc_id"), pa.array(found, pa.string()), pa.array(score, pa.float64())],
                                      names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")
