"""Benchmark decontamination: a BM25 inverted index of test items searched by block-max WAND, then verification.

The index holds the test items; every passage of every training text is a query against
it. Passages are windows of two neighbouring halves of ``HALF`` words, so an item of up
to ``HALF`` words lies whole in one of them. A longer item does not; it is an entry as a
whole and once more as overlapping pieces of ``HALF`` words. A hit of a piece is a hit of
the item. An entry's impacts are divided by its BM25 score against itself, so scores run
from 0 to 1 and one threshold serves items of all lengths. Document frequencies, item
count and mean length are those of all items, however they are dealt to indexes.

An index is a table of postings (term, entry, impact) in order of term and entry, with
each list's largest impact and the largest one of each block of ``BLOCK`` entries (entries
are numbered by length, so blocks hold alike ones). All entries that reach the threshold
are found:

- a window whose block maxima stay below the threshold in every block is done;
- each other window has one cursor for each of its lists. The cursors stand in order of
  their entries; the pivot is the first at which the lists' maxima add up to the
  threshold. If the block maxima at the pivot do not reach it, the cursors up to the pivot
  jump behind the block or to the next cursor, else they go to the pivot, which is scored.

The cursors of all windows of a slice take each step together, as arrays. A hit is
confirmed on the words themselves: of the word pairs of the item's question part and of
its answer part, a share of ``OVERLAP`` each must stand in the text where the item would
lie, or of ``TOGETHER`` over both parts.

Items are dealt to indexes by about ``PART_BYTES`` bytes of text, which bounds what is
broadcast; texts pass each index once, so they are read once up to that size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.checkpoints import cut
from sparkgauge.llm import kernels as K

HALF, BLOCK, PART_BYTES = 64, 4, 16 << 20
SCORE, OVERLAP, TOGETHER = 0.5, 0.5, 0.75
K1, B = 1.2, 0.75
#: What rounding may take from a bound.
SLACK = 1e-6
_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False


def lowered(raw: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters of a UTF-8 buffer in lower case."""
    out = K.LOWER[raw]
    wide = np.zeros(len(raw), bool)
    wide[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    out[wide] += 0x20
    return out


def _hashed(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words before each text): runs of letters, digits and non-ASCII bytes in lower case."""
    raw = lowered(raw)
    start, end, first = K.words(raw, offsets, _APART)
    return K.word_hashes(raw, start, end, lower=False), first


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _hashed(data, np.array([0, len(data)]))[0]


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The words of an item before its last sentence, and those of it; one sentence is cut at three quarters."""
    parts = [h for h in (word_hashes(p) for p in re.split(r"(?<=[.?!:])\s+|\n", text)) if len(h)]
    if len(parts) < 2:
        every = word_hashes(text)
        cut_ = max(1, len(every) * 3 // 4)
        return every[:cut_], every[cut_:]
    return np.concatenate(parts[:-1]), parts[-1]


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; of a single word its own one."""
    return K.mix(h[:-1] * K.U64(0x9E3779B97F4A7C15) + h[1:]) if len(h) != 1 else h


@dataclass
class Index:
    ids: list[int]
    lengths: np.ndarray  # words of each item
    questions: list[np.ndarray]  # distinct pairs of the question part, sorted
    answers: list[np.ndarray]
    owner: np.ndarray  # the item of each entry
    place: np.ndarray  # where the entry begins in its item
    vocabulary: np.ndarray  # sorted word hashes
    most: np.ndarray  # largest impact of each term's list
    lists: np.ndarray  # first posting of each list, and the number of postings
    entries: np.ndarray  # entry of each posting
    impacts: np.ndarray  # impact of each posting
    block_lists: np.ndarray  # first block of each list, and the number of blocks
    block_ids: np.ndarray
    block_most: np.ndarray

    @property
    def keys(self) -> np.ndarray:
        """(term, entry) of each posting as one rising number."""
        return np.repeat(np.arange(len(self.most)), np.diff(self.lists)) * (len(self.owner) + 1) + self.entries

    @property
    def block_keys(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.most)), np.diff(self.block_lists)) * (len(self.owner) // BLOCK + 1) + self.block_ids


def _piece_starts(n: int) -> np.ndarray:
    """Where the pieces of an item of ``n`` words begin; the last one ends with the item."""
    return np.append(np.arange(0, n - HALF, HALF // 2), n - HALF) if n > HALF else np.zeros(0, np.int64)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after another."""
    done = np.cumsum(length)
    return np.arange(done[-1] if len(done) else 0) + np.repeat(start - (done - length), length)


def build(items: list[tuple[int, str]], spread: dict[int, int] | None = None, total: int | None = None, mean: float | None = None) -> Index | None:
    """The index of (item_id, text) items; items without words are left out.

    ``spread`` has the number of items with each word (by its hash), ``total`` and ``mean``
    the number of all items with a word and their mean length; by default those of ``items``.
    """
    known = sorted(((i, text, word_hashes(text or "")) for i, text in items), key=lambda x: (len(x[2]), x[0]))
    known = [x for x in known if len(x[2])]
    if not known:
        return None
    lengths = np.array([len(h) for *_, h in known])
    vocabulary, term = np.unique(np.concatenate([h for *_, h in known]), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(lengths)])
    if spread is None:
        pairs = np.unique(np.repeat(np.arange(len(known)), lengths) * len(vocabulary) + term)
        often, total, mean = np.bincount(pairs % len(vocabulary), minlength=len(vocabulary)), len(known), float(lengths.mean())
    else:
        often = np.array([spread[x] for x in vocabulary.view(np.int64).tolist()])
    weight = np.log1p((total - often + 0.5) / (often + 0.5))

    starts = [_piece_starts(n) for n in lengths]
    owner = np.concatenate([np.arange(len(known)), np.repeat(np.arange(len(known)), [len(s) for s in starts])])
    place = np.concatenate([np.zeros(len(known), np.int64), *starts]).astype(np.int64)
    size = np.concatenate([lengths, np.full(len(owner) - len(known), HALF)])
    order = np.lexsort((owner, size))
    owner, place, size = owner[order], place[order], size[order]

    keys, often_in = np.unique(term[_ranges(first[owner] + place, size)] * len(owner) + np.repeat(np.arange(len(owner)), size), return_counts=True)
    of, entry = keys // len(owner), keys % len(owner)
    impact = weight[of] * often_in * (K1 + 1) / (often_in + (K1 * (1 - B + B * size / mean))[entry])
    impact = (impact / np.bincount(entry, impact, len(owner))[entry]).astype(np.float32)
    lists = np.searchsorted(of, np.arange(len(vocabulary) + 1))
    edge = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(entry // BLOCK, prepend=-1) != 0))
    parts = [question_and_answer(text) for _, text, _ in known]
    return Index(
        [i for i, *_ in known], lengths, [np.unique(_pairs(q)) for q, _ in parts], [np.unique(_pairs(a)) for _, a in parts], owner, place, vocabulary,
        np.maximum.reduceat(impact, lists[:-1]), lists, entry.astype(np.int32), impact, np.searchsorted(of[edge], np.arange(len(vocabulary) + 1)),
        (entry[edge] // BLOCK).astype(np.int32), np.maximum.reduceat(impact, edge),
    )


def windows(hashes: np.ndarray, first: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows before each text, and the distinct known (window, term) pairs sorted by window).

    A text of n words has max(1, halves - 1) windows, numbered through the slice.
    """
    n = np.diff(first)
    halves = -(-n // HALF)
    count = np.maximum(halves - 1, np.minimum(halves, 1))
    base = np.concatenate([[0], np.cumsum(count)])
    term = np.searchsorted(index.vocabulary, hashes)
    hit = np.flatnonzero(index.vocabulary[np.minimum(term, len(index.vocabulary) - 1)] == hashes)
    term = term[hit]
    text = np.searchsorted(first, hit, "right") - 1
    half = (hit - first[text]) // HALF
    right = np.minimum(half, count[text] - 1)
    left = np.maximum(half - 1, 0)
    terms = len(index.vocabulary)
    keys = np.unique(np.concatenate([(base[text] + right) * terms + term, ((base[text] + left) * terms + term)[left != right]]))
    return base, keys // terms, keys % terms


def _promising(window: np.ndarray, term: np.ndarray, index: Index, least: float) -> np.ndarray:
    """Which (window, term) pairs belong to windows in which the block maxima of some block reach ``least``."""
    names, at = np.unique(window, return_inverse=True)
    ok = np.zeros(len(names), bool)
    width = len(index.owner) // BLOCK + 1
    per_pair = np.diff(index.block_lists)[term]
    done = np.cumsum(per_pair)
    border = np.flatnonzero(np.diff(at, prepend=-1))
    low = 0
    while low < len(names):  # some windows at a time, by the postings of their blocks and the grid of their sums
        before = done[border[low] - 1] if border[low] else 0
        high = int(np.searchsorted(done[np.append(border[1:], len(at)) - 1], before + (2 << 20), "right"))
        high = min(max(low + 1, high), low + max(1, (4 << 20) // width), len(names))
        a, b = border[low], border[high] if high < len(names) else len(at)
        rows = _ranges(index.block_lists[term[a:b]], per_pair[a:b])
        sums = np.bincount(np.repeat(at[a:b] - low, per_pair[a:b]) * width + index.block_ids[rows], index.block_most[rows], (high - low) * width)
        ok[low:high] = sums.reshape(-1, width).max(1) >= least
        low = high
    return ok[at]


def wand(window: np.ndarray, term: np.ndarray, index: Index, least: float = SCORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, entry, score) of all entries that reach ``least``; the (window, term) pairs are distinct and sorted by window."""
    bound = least - SLACK
    keep = _promising(window, term, index, bound)
    window, term = window[keep], term[keep]
    keys, block_keys, wide, blocks = index.keys, index.block_keys, len(index.owner) + 1, len(index.owner) // BLOCK + 1
    at, end = index.lists[term], index.lists[term + 1]
    found: list[tuple] = []
    while len(window):
        entry = index.entries[at].astype(np.int64)
        order = np.argsort(window * wide + entry, kind="stable")
        window, term, at, end, entry = window[order], term[order], at[order], end[order], entry[order]
        head = np.flatnonzero(np.diff(window, prepend=-1))
        size = np.diff(np.append(head, len(window)))
        # the pivot: the first cursor at which the lists' maxima add up
        run = np.cumsum(index.most[term], dtype=np.float64)
        run -= np.repeat(run[head] - index.most[term[head]], size)
        reach = np.flatnonzero(run >= bound)
        pivot = np.full(len(head), -1)
        of = np.searchsorted(head, reach, "right") - 1
        pivot[of[::-1]] = reach[::-1]
        live = np.repeat(pivot >= 0, size)
        goal = np.repeat(np.where(pivot >= 0, entry[pivot], 0), size)
        window, term, at, end, entry, goal = (x[live] for x in (window, term, at, end, entry, goal))
        if not len(window):
            break
        head = np.flatnonzero(np.diff(window, prepend=-1))
        size = np.diff(np.append(head, len(window)))
        upto = entry <= goal
        # the block maxima at the pivot, over the cursors up to it
        near = np.flatnonzero(upto)
        want = term[near] * blocks + goal[near] // BLOCK
        spot = np.minimum(np.searchsorted(block_keys, want), len(block_keys) - 1)
        most = np.zeros(len(term))
        most[near] = np.where(block_keys[spot] == want, index.block_most[spot], 0)
        good = np.repeat(np.add.reduceat(most, head) >= bound, size)
        # below: behind the block, or to the first cursor after the pivot
        after = np.minimum.reduceat(np.where(upto, wide, entry), head)
        jump = np.minimum((goal // BLOCK + 1) * BLOCK, np.repeat(after, size))
        # else: the pivot is scored
        seek = np.where(good, goal, jump)
        lag = np.flatnonzero(upto & (entry < seek))
        at[lag] = np.searchsorted(keys, term[lag] * wide + seek[lag])
        here = good & (at < end)
        here[here] = index.entries[at[here]] == goal[here]
        score = np.add.reduceat(np.where(here, index.impacts[np.minimum(at, len(index.impacts) - 1)], 0).astype(np.float64), head)
        hit = (score >= least) & good[head]
        found.append((window[head[hit]], goal[head[hit]], score[hit]))
        at = at + here
        left = at < end
        window, term, at, end = (x[left] for x in (window, term, at, end))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _share(want: np.ndarray, there: np.ndarray) -> float:
    if not len(want):
        return 1.0
    spot = np.minimum(np.searchsorted(there, want), len(there) - 1)
    return float((there[spot] == want).mean())


def hits(texts: pa.Array, index: Index) -> Iterator[dict[int, tuple[float, float, float]]]:
    """For each text its confirmed items, with the best score and its overlaps."""
    raw, at = K.utf8(texts)
    for i, j in K.slices(at):
        hashes, first = _hashed(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        base, window, term = windows(hashes, first, index)
        out: list[dict] = [{} for _ in range(j - i)]
        seen: dict[tuple, tuple[float, float]] = {}
        for w, entry, score in zip(*(x.tolist() for x in wand(window, term, index)), strict=True):
            item, text = int(index.owner[entry]), int(np.searchsorted(base, w, "right")) - 1
            n = int(index.lengths[item])
            begin = (w - int(base[text])) * HALF - int(index.place[entry])  # where the item would begin
            near = 2 * HALF + n // 4
            spot = (text, item, begin // near)
            if spot not in seen:
                x, y = max(0, begin - 2 * near), min(int(first[text + 1] - first[text]), begin + n + 3 * near)
                own = hashes[first[text] + x : first[text] + y]
                there = np.unique(np.concatenate([_pairs(own), own]))
                seen[spot] = _share(index.questions[item], there), _share(index.answers[item], there)
            q, a = seen[spot]
            m, k = len(index.questions[item]), len(index.answers[item])
            sure = min(q, a) >= OVERLAP or q * m + a * k >= TOGETHER * (m + k)
            if sure and (score, q, a) > out[text].get(item, (0,)):
                out[text][item] = (score, q, a)
        yield from out


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = [word_hashes(t.as_py()) for t in batch.column(0)]
        yield pa.record_batch([pa.array([len(h) for h in every], pa.int64()), pa.array([np.unique(h).view(np.int64) for h in every], pa.list_(pa.int64()))], names=["words", "terms"])


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", part_bytes: int | None = None) -> Iterator[Index]:
    """Indexes over all items, of about ``part_bytes`` bytes of text each. Null texts are left out."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // (part_bytes or PART_BYTES))
    if not parts:
        return
    said = cut(K.arrow(items.select("text"), _item_words, "words long, terms array<long>").where("words > 0"))
    total, mean = said.agg(F.count(F.lit(1)), F.avg("words")).first()
    spread = said.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    if parts > 1:
        spread = cut(spread)
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k)
        terms = spread
        if parts > 1:  # only the words of this part
            terms = spread.join(K.arrow(own.select("text"), _item_words, "words long, terms array<long>").select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
        if built := build([tuple(r) for r in own.collect()], {r.term: r.n for r in terms.collect()}, total, mean):
            yield built


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int | None = None) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every confirmed pair.

    Null and empty texts match nothing; repeated rows match each; ids may be null; other
    columns are ignored. Without items or documents the result is empty.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for index in indexes(benchmark, part_bytes=part_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                rows = [(doc, own.ids[k], *x) for doc, found in zip(batch.column(0).to_pylist(), hits(batch.column(1), own), strict=True) for k, x in sorted(found.items())]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = K.arrow(texts, run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", part_bytes: int | None = None) -> DataFrame:
    """``docs`` without the rows whose text holds a confirmed item.

    All columns stay, of whatever name. Null and empty texts stay; repeated rows stay or go
    together; an empty table gives an empty result, and an empty benchmark changes nothing.
    """
    for index in indexes(benchmark, part_bytes=part_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not found for found in hits(batch.column(text_col), sent.value)], pa.bool_()))

        docs = K.arrow(docs, run, docs.schema)
    return docs
