"""Order-preserving packing of documents into token windows by dynamic programming.

The documents of a partition, in their order, form one stream of tokens (each document's
ids, then the separator). The stream is cut into windows of at most ``LENGTH`` tokens.
Cuts stand at document or sentence borders; where none is within reach (a sentence longer
than a window), at exactly ``LENGTH`` tokens. The cuts minimise the sum of padding, of
``SENTENCE`` for each cut inside a document (``HARD`` inside a sentence) and of ``EACH``
for each window. With f(j) the least cost of cutting at place c(j),

    f(j) = penalty(j) + EACH + LENGTH - c(j) + min(f(i) + c(i) for c(j) - LENGTH <= c(i) < c(j))

and the minimum of the sliding range is kept in a monotone queue, so each border enters
and leaves it once. A window of exactly 256, 512 or 1024 tokens needs no padding and has
a transition of its own. The stream is solved in blocks of about ``BLOCK`` tokens: a block
keeps its windows up to its cheapest late cut and hands the rest to the next, so memory
is bounded by a block and the longest document, and only the last window of a partition
is left short. No document leaves its partition, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm import kernels as K

LENGTH, SEPARATOR = 2048, 1
SENTENCE, HARD, EACH, BLOCK = 16, 512, 8, 1 << 20
WHOLE = (256, 512, 1024)


@lru_cache(2)
def _encoder(vocabulary: str | None) -> tuple[Callable[[str], np.ndarray], np.ndarray]:
    """(text to ids, whether an id ends a sentence), from a byte-level BPE vocabulary.

    The ids are those of the ``tokenizers`` file. ``tiktoken`` holds the same merges and
    gives the same ids faster; texts that contain one of the file's added tokens go to
    ``tokenizers`` itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ends = np.zeros(max(plain.get_vocab_size(), len(ranks)) + 1, bool)
    for token, i in ranks.items():
        ends[i] = b"\n" in token or token.rstrip(b"\"')]").endswith((b".", b"!", b"?"))

    def encode(text: str) -> np.ndarray:
        if vocabulary or any(a in text for a in added):
            return np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(quick.encode_ordinary(text), np.uint32)

    return encode, ends


def best_cuts(places: list[int], penalty: list[int], final: bool) -> list[int]:
    """Indexes into ``places`` where windows end, in order; the stream starts at 0.

    Neighbouring places are at most LENGTH apart. If ``final``, the last place is a cut;
    else the last cut is the cheapest place (of several, the latest) less than LENGTH
    before the end, and what comes after it is not cut.
    """
    n = len(places)
    cost, back = [0] * n, [-1] * n
    index = {p: i for i, p in enumerate(places)}
    queue: deque[tuple[int, int, int]] = deque([(0, 0, -1)])  # (f + place, place, index), keys rising
    for j, (place, extra) in enumerate(zip(places, penalty, strict=True)):
        while queue[0][1] < place - LENGTH:
            queue.popleft()
        key, _, i = queue[0]
        best = key + LENGTH - place
        for whole in WHOLE:
            k = index.get(place - whole, -1 if place == whole else None)
            if k is not None and (f := cost[k] if k >= 0 else 0) < best:
                best, i = f, k
        best += extra + EACH
        cost[j], back[j] = best, i
        key = best + place
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, place, j))
    j = n - 1
    if not final:
        late = [i for i in range(max(0, n - LENGTH), n) if places[i] > places[-1] - LENGTH]
        j = min(late, key=lambda i: (cost[i], -i))
    out = []
    while j >= 0:
        out.append(j)
        j = back[j]
    return out[::-1]


def _borders(pieces: list[tuple], ends: np.ndarray) -> tuple[list[int], list[int]]:
    """All places where the stream of pieces can be cut, and their penalties."""
    ids = np.concatenate([p[3] for p in pieces])
    done = np.cumsum([len(p[3]) for p in pieces])
    hit = np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1
    places = np.union1d(hit, done)
    gaps = np.diff(places, prepend=0)
    wide = np.flatnonzero(gaps > LENGTH)
    forced = np.concatenate([np.arange(places[k] - gaps[k] + LENGTH, places[k], LENGTH) for k in wide]) if len(wide) else np.zeros(0, np.int64)
    every = np.union1d(places, forced)
    cost = np.where(np.isin(every, done), 0, np.where(np.isin(every, hit), SENTENCE, HARD))
    return every.tolist(), cost.tolist()


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])


def pack_stream(documents: Iterator[tuple[int | None, np.ndarray]], ends: np.ndarray, first_sequence: int = 0) -> Iterator[tuple]:
    """(doc_id, start, ids, doc_tokens, sequence, offset) for each piece of (doc_id, ids) documents."""
    held: list[tuple] = []  # (doc_id, doc_tokens, start, ids)
    size, sequence = 0, first_sequence

    def solve(final: bool) -> Iterator[tuple]:
        nonlocal held, size, sequence
        places, cost = _borders(held, ends)
        stops = [places[j] for j in best_cuts(places, cost, final)]
        rest, at, k, offset = [], 0, 0, 0
        for doc, total, start, ids in held:
            while len(ids):
                if k == len(stops):
                    rest.append((doc, total, start, ids))
                    break
                n = min(len(ids), stops[k] - at)
                yield doc, start, ids[:n], total, sequence, offset
                start, ids, at, offset = start + n, ids[n:], at + n, offset + n
                if at == stops[k]:
                    k, offset, sequence = k + 1, 0, sequence + 1
        held, size = rest, sum(len(p[3]) for p in rest)

    for doc, ids in documents:
        held.append((doc, len(ids), 0, ids))
        size += len(ids)
        if size >= BLOCK:
            yield from solve(False)
    if held:
        yield from solve(True)


def _pack(vocabulary: str | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = _encoder(vocabulary)
        stop = np.array([SEPARATOR], np.uint32)

        def documents():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield doc, np.concatenate([encode(text.as_py() or ""), stop])

        def table(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, total, sequence, offset = zip(*rows, strict=True)
            cols = [doc, start, [len(x) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], total, sequence, offset]
            cols = [pa.array(c, f.type) for c, f in zip(cols, _OUT)]
            return pa.record_batch([*cols, pa.array([x.astype(np.int32) for x in ids], _OUT.field(7).type)], schema=_OUT) if with_ids else pa.record_batch(cols, schema=pa.schema(list(_OUT)[:7]))

        rows: list[tuple] = []
        for row in pack_stream(documents(), ends, TaskContext.get().partitionId() << 33):
            rows.append(row)
            if len(rows) == 2048:
                yield table(rows)
                rows = []
        if rows:
            yield table(rows)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    ``sequence_id`` is unique and rises within a partition; pieces of a sequence are
    gapless from offset 0. Null and empty texts are one separator; a null id stays null;
    repeated rows are packed each. Other columns are ignored. ``vocabulary`` is the path
    of another ``tokenizers`` file. An empty table gives an empty result.
    """
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return K.arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), _pack(vocabulary, with_ids), kind)
