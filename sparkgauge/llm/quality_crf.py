"""Document quality from a conditional random field over lines.

Every line has features of its own (symbols, exclamation marks, upper case, bars, digits,
repeated words, repetition of earlier lines, length) and those of the lines before and
after it. A linear-chain model with the states bad and good gives each line's marginal by
forward-backward, and a document's score is their mean weighted by the lines' bytes.

Labels are known for documents, not for lines, so a line's state is latent: a document's
label is noisy evidence on each of its lines (``STRAY``: how likely a bad line is in a good
document and a good line in a bad one), and the fit sums over the states. A bad document
may thus hold good lines and the chain learns where one kind follows another.

The model is fitted on the driver from whole texts of at most ``SAMPLE`` labelled
documents, those with the smallest hashes of their ids. Scoring reads every line of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm import crf
from sparkgauge.llm import kernels as K

SAMPLE, THRESHOLD = 3000, 0.3
#: How likely a bad line is in a good document, and a good line in a bad one.
STRAY = (0.02, 0.2)
_KINDS = np.zeros((5, 256), bool)
_KINDS[0, list(b"#*$%&<>~^@")] = True
_KINDS[1, list(b"!?")] = True
_KINDS[2, 65:91] = True
_KINDS[3, list(b"|")] = True
_KINDS[4, 48:58] = True
OWN = 15
WIDTH = 1 + 3 * OWN


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features (lines, WIDTH), bytes of each line, lines before each text); a text has its \\n count + 1 lines."""
    breaks = np.flatnonzero(raw == 10)
    per_text = np.diff(np.searchsorted(breaks, offsets)) + 1
    first = np.concatenate([[0], np.cumsum(per_text)])
    n = int(first[-1])
    text_of = np.repeat(np.arange(len(per_text)), per_text)
    start, end = np.empty(n, np.int64), np.empty(n, np.int64)
    head = np.zeros(n, bool)
    tail = np.zeros(n, bool)
    head[first[:-1]] = True
    tail[first[1:] - 1] = True
    start[head], end[tail] = offsets[:-1], offsets[1:]
    start[~head], end[~tail] = breaks + 1, breaks
    size = end - start
    x = np.zeros((n, OWN), np.float32)
    ws, we, _ = K.words(raw, offsets)
    border = np.searchsorted(ws, np.append(start, len(raw)))
    words = np.searchsorted(ws, end) - border[:-1]
    per_word, per_byte = 1 / np.maximum(words, 1), 1 / np.maximum(size, 1)
    for k, scale in enumerate((per_word, per_word, per_byte, per_word, per_byte)):
        hits = np.flatnonzero(_KINDS[k][raw])
        x[:, k] = np.minimum((np.searchsorted(hits, end) - np.searchsorted(hits, start)) * scale, 4)
    h = K.word_hashes(raw, ws, we)
    line_of_word = np.repeat(np.arange(n), words)
    again = np.zeros((2, len(h)), bool)
    again[0, 1:] = (h[1:] == h[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    by_text = K.mix(h ^ K.mix(text_of[line_of_word].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(by_text, kind="stable")
    again[1, order[1:]] = by_text[order[1:]] == by_text[order[:-1]]
    for k in range(2):
        x[:, 5 + k] = np.bincount(line_of_word, again[k], n) * per_word
    whole = K.word_hashes(raw, start, end, lower=False)
    whole = K.mix(whole ^ K.mix(text_of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(whole, kind="stable")
    same = np.zeros(n, bool)
    same[order[1:]] = whole[order[1:]] == whole[order[:-1]]
    x[:, 7] = same & (words > 0)
    x[:, 8] = np.log1p(words) / 4
    x[:, 9] = words == 0
    x[:, 10] = np.where(words > 0, np.minimum(size * per_word, 30) / 10, 0)
    x[:, 11] = x[:, 0] > 0.3
    x[:, 12] = x[:, 3] > 0.3
    x[:, 13] = x[:, 5] > 0.3
    x[:, 14] = (x[:, 2] > 0.4) & (x[:, 1] > 0.3)
    out = np.zeros((n, WIDTH), np.float32)
    out[:, 0] = 1
    out[:, 1 : 1 + OWN] = x
    out[1:, 1 + OWN : 1 + 2 * OWN] = x[:-1]
    out[head, 1 + OWN : 1 + 2 * OWN] = 0
    out[:-1, 1 + 2 * OWN :] = x[1:]
    out[tail, 1 + 2 * OWN :] = 0
    return out, size, first


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = K.utf8(batch.column(1))
        rows = []
        for i, j in K.slices(at):
            x, _, first = line_features(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            rows += [x[first[k] : first[k + 1]].tobytes() for k in range(j - i)]
        yield pa.record_batch([batch.column(0), pa.array(rows, pa.binary())], names=["label", "lines"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """(W, T) of the line model; zeros (all scores 0.5) unless the sample has both labels.

    Labels other than 0 and 1, and ids that occur with both, are left out. Repeated rows
    count once; an id with several texts stands for one of them (that of the smallest hash).
    """
    clear = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    clear = clear.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high").select("id", "label")
    chosen = clear.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    one = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = K.arrow(one.select("label", "text"), _sampled, "label int, lines binary").collect()  # at most SAMPLE rows
    rows = sorted((r.label, bytes(r.lines)) for r in rows)
    if len({r[0] for r in rows}) < 2:
        return np.zeros((WIDTH, 2)), np.zeros((2, 2))
    lines = np.frombuffer(b"".join(b for _, b in rows), np.float32).reshape(-1, WIDTH)
    size = np.array([len(b) // (4 * WIDTH) for _, b in rows])
    label = np.repeat([r[0] for r in rows], size)
    in_good, in_bad = np.array([STRAY[0], 1 - STRAY[1]]), np.array([1 - STRAY[0], STRAY[1]])
    evidence = np.log(np.where(label[:, None] == 1, in_good, in_bad))
    return crf.train(lines, np.concatenate([[0], np.cumsum(size)]), evidence, rounds=90, rate=0.25, decay=1e-4)


def line_scores(column: pa.Array, w: np.ndarray, t: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(P(good) of each line, bytes of each line, lines before each text) for consecutive slices of the texts."""
    raw, at = K.utf8(column)
    for i, j in K.slices(at, 2 << 20):
        x, size, first = line_features(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        yield crf.marginals(x @ w, first, t)[:, 1], size, first


def score_texts(column: pa.Array, w: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The score of each text, 0 to 1."""
    out = []
    for good, size, first in line_scores(column, w, t):
        weight = np.maximum(size, 1)
        out.append(np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]))
    return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (double) and ``predicted`` (int, 1 from ``threshold`` on).

    A null or empty text is one empty line and gets the model's score for that. Repeated
    rows are scored alike; other columns stay; an empty table gives an empty result.
    """
    w, t = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score_texts(batch.column(text_col), w, t)
            yield pa.record_batch([*batch.columns, pa.array(s, pa.float64()), pa.array(s >= threshold).cast(pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    kept = docs.drop("score", "predicted")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return K.arrow(kept, run, f"{kind}, score double, predicted int")
