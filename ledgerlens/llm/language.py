"""Language identification as a mixture of languages per document (operator 8).

Byte trigrams inside words are counted per language over the labelled rows. A new document is a mixture: each word comes from
one of its languages, with the likelihood of its trigrams. Expectation-maximisation gives the proportions; of the sets
of the most frequent languages the one with the best likelihood less half a logarithm of the number of words per language
(as in BIC) is kept, and the largest proportion in it gives the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import slices
from ledgerlens.llm.kernels import column_bytes

#: Trigrams are counted in this many cells per language.
CELLS = 1 << 16
#: Added to each count, so that no trigram has probability zero.
PRIOR = 0.5
UNKNOWN = "und"
STEPS = 8
_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


@dataclass
class LanguageModel:
    """Languages in alphabetical order and the logarithm of each trigram cell's probability, one row per language."""

    languages: list[str]
    logs: np.ndarray


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the trigrams around each letter, the first trigram of each word, the first word of each row, rows with an ASCII letter."""
    raw, offsets = column_bytes(column)
    padded = np.zeros(len(raw) + 2, np.uint8)
    padded[1:-1] = _LETTER[raw]
    inner = padded[1:-1]
    before, after = padded[:-2].copy(), padded[2:].copy()
    borders = offsets[:-1][offsets[:-1] < len(raw)]
    before[borders] = 0
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    after[ends] = 0
    at = np.flatnonzero(inner)
    code = (before[at].astype(np.uint32) << np.uint32(16)) | (inner[at].astype(np.uint32) << np.uint32(8)) | after[at]
    cells = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    words = np.flatnonzero(before[at] == 0)
    rows = np.searchsorted(at[words], offsets) if len(words) else np.zeros(len(offsets), np.int64)
    ascii_letters = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((inner > 0) & (inner < 128), out=ascii_letters[1:])
    return cells, words, rows, ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]


def fit_languages(docs: DataFrame, use: Column, label: str = "lang", text: str = "text") -> LanguageModel:
    """Count trigrams per language over all rows where ``use`` holds and ``label`` and text are not null.

    Counts are summed in each task, then over tasks; the driver gets at most CELLS numbers per language. Without a labelled row the
    model has no language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            labels = np.array(batch.column("label").to_pylist(), dtype=object)
            for name in sorted(set(labels)):
                cells, *_ = _grams(batch.column("text").filter(pa.array(labels == name)))
                sums[name] = sums.get(name, 0) + np.bincount(cells, minlength=CELLS)
        for name, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["label", "cell", "n"])

    labelled = docs.where(use & F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label"))
    counts = labelled.mapInArrow(count, "label string, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("label").to_pylist()))
    table = np.full((len(names), CELLS), PRIOR)
    if names:
        table[np.searchsorted(names, counts.column("label").to_pylist()), counts.column("cell").to_numpy()] += counts.column("n").to_numpy()
    return LanguageModel(names, np.log(table / table.sum(1, keepdims=True)).astype(np.float32) if names else table)


def _mixtures(likely: np.ndarray, rows: np.ndarray, allowed: np.ndarray, shares: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once: shares of the allowed languages and the log likelihood (up to a constant per document)."""
    count = np.diff(rows)
    starts = rows[:-1][count > 0]
    some = count > 0
    doc = np.repeat(np.arange(int(some.sum())), count[some])
    shares, allowed = (shares * allowed)[some], allowed[some]
    shares /= np.maximum(shares.sum(1, keepdims=True), 1e-12)
    total = np.zeros(len(starts))
    for step in range(steps + 1):
        joint = likely * shares[doc]
        norm = np.maximum(joint.sum(1), 1e-30)
        if step == steps:
            total = np.add.reduceat(np.log(norm), starts) if len(starts) else total
            break
        joint /= norm[:, None]
        if len(starts):
            shares = np.add.reduceat(joint, starts, axis=0) / count[some][:, None].astype(np.float32)
    out, score = np.zeros((len(count), likely.shape[1]), np.float32), np.zeros(len(count))
    out[some], score[some] = shares, total
    return out, score


def mixtures(model: LanguageModel, column: pa.Array, steps: int = STEPS) -> np.ndarray:
    """Shares of the languages of each text, zero for those left out by the penalised likelihood, all zero without letters."""
    cells, words, rows, has_letter = _grams(column)
    for i in np.flatnonzero(~has_letter & (np.diff(rows) > 0)):
        has_letter[i] = any(map(str.isalpha, column[int(i)].as_py()))
    k = len(model.languages)
    if not k or not len(words):
        return np.zeros((len(column), k), np.float32)
    logs = np.stack([np.add.reduceat(model.logs[j][cells], words) for j in range(k)], 1)
    likely = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -60))
    n = len(column)
    shares, _ = _mixtures(likely, rows, np.ones((n, k), bool), np.full((n, k), 1 / k, np.float32), steps)
    rank = np.argsort(np.argsort(-shares, axis=1, kind="stable"), axis=1, kind="stable")
    best, best_score = np.zeros((n, k), np.float32), np.full(n, -np.inf)
    penalty = 0.5 * np.log(np.maximum(np.diff(rows), 2))
    for size in range(1, k + 1):
        fitted, total = _mixtures(likely, rows, rank < size, np.maximum(shares, 1e-6), 0 if size == 1 else 2)
        total = total - penalty * size
        better = total > best_score
        best[better], best_score[better] = fitted[better], total[better]
    best[~has_letter] = 0
    return best


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add lang_pred, score and languages to every row; only ``text`` is read for them.

    ``languages`` lists the kept languages with their shares (three decimals, largest first), ``score`` is the largest share.
    Null texts and texts without a letter: ``und``, 0.0 and an empty string; so does every text if the model has no
    language. Equal shares: the first language by name. Columns of the same names are replaced.
    """
    kept = docs.drop("lang_pred", "score", "languages")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS numbers per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, text):
            found = mixtures(own, batch.column(text))
            top = found.argmax(1) if found.shape[1] else np.zeros(len(found), np.int64)
            score = found.max(1, initial=0).astype(np.float64)
            names = [own.languages[j] if s > 0 else UNKNOWN for j, s in zip(top, score, strict=True)]
            lists = [",".join(f"{own.languages[j]}:{row[j]:.3f}" for j in np.argsort(-row, kind="stable") if row[j] > 0) for row in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names), pa.array(np.minimum(score, 1.0)), pa.array(lists, pa.string())], [*batch.schema.names, "lang_pred", "score", "languages"])

    return kept.mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5
