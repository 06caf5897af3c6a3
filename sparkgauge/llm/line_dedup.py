"""Removal of globally repeated multi-line chunks.

Texts are cut into chunks of lines at content-defined borders: a rolling hash over the
hashes of the last ``WINDOW`` lines ends a chunk where it is 0 modulo ``MODULUS``, so an
insertion moves only nearby borders. A line of ``LONG_WORDS`` words or more is a chunk by
itself, and a chunk ends after ``MOST_LINES`` lines at the latest. A chunk counts as
repeated when it has at least two lines with a word, or is such a long line, and stands
byte for byte at another place. The first place, by (doc_id, place in the text), stays.

Borders of a repeated passage fall where its surroundings put them, so chunks alone leave
its ends, and all of a short one. With ``runs`` each two neighbouring lines with a word
(and the blank lines between) are looked up as well, wherever the borders are: a run of
two or more such lines that stands at another place is made of repeated pairs and goes as
a whole. A pair that overlaps the first place of the same pair stays.

128-bit hashes of the chunks are grouped first; only documents with a repeated hash send
the bytes of those chunks, which are grouped by the bytes themselves. The texts are
shuffled once: both the comparison and the removal read that exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgauge.checkpoints import cut
from sparkgauge.llm import kernels as K

WINDOW, MODULUS, MOST_LINES, LONG_WORDS = 2, 3, 64, 50
_M64 = (1 << 64) - 1


def chunks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(first line, line after the last, can be removed) of each chunk of a text's \\n-split lines."""
    yield from _chunks(text.split("\n"))


def _chunks(lines: list[str]) -> Iterator[tuple[int, int, bool]]:
    start, worded = 0, 0
    recent = [0] * WINDOW
    for i, line in enumerate(lines):
        raw = line.encode()
        if len(raw) >= 2 * LONG_WORDS - 1 and len(raw.split()) >= LONG_WORDS:
            if i > start:
                yield start, i, worded >= 2
            yield i, i + 1, True
            start, worded, recent = i + 1, 0, [0] * WINDOW
            continue
        worded += bool(raw.strip())
        recent = [*recent[1:], xxhash.xxh3_64_intdigest(raw)]
        rolled = 0
        for h in recent:
            rolled = (rolled * 0x9E3779B97F4A7C15 + h) & _M64
        if (rolled >> 20) % MODULUS == 0 or i + 1 - start >= MOST_LINES:
            yield start, i + 1, worded >= 2
            start, worded = i + 1, 0
    if start < len(lines):
        yield start, len(lines), worded >= 2


def _units(lines: list[str], runs: bool) -> Iterator[tuple[int, int]]:
    """(first line, line after the last) of all that is looked up: chunks, and with ``runs`` pairs of lines with a word."""
    worded = [k for k, line in enumerate(lines) if line.encode().strip()] if runs else []
    for i, j, able in _chunks(lines):
        # the pairs of a chunk of more lines with a word at both ends say the same
        if able and not (runs and j - i > 1 and lines[i].encode().strip() and lines[j - 1].encode().strip()):
            yield i, j
    for i, k in zip(worded, worded[1:], strict=False):
        yield i, k + 1


def _hash(chunk: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(chunk.encode())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(h >> 64), signed(h & _M64)


_CHUNK = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("place", pa.int32()), ("end", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def _hashed(runs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text:
                    lines = text.split("\n")
                    out += [(doc, row, i, j, *_hash("\n".join(lines[i:j]))) for i, j in _units(lines, runs)]
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), _CHUNK, strict=True)] if out else [pa.array([], f.type) for f in _CHUNK], schema=_CHUNK)

    return run


def _repeated(text_col: str):
    """The bytes of the chunks whose hash is repeated."""
    kind = _CHUNK.append(pa.field("chunk", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, row, text, found in zip(*(batch.column(c).to_pylist() for c in ("__id", "__row", text_col, "__found")), strict=True):
                if found:
                    lines = text.split("\n")
                    out += [(doc, row, x["place"], x["end"], x["h1"], x["h2"], "\n".join(lines[x["place"] : x["end"]])) for x in found]
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), kind, strict=True)] if out else [pa.array([], f.type) for f in kind], schema=kind)

    return run


def _removal(names: list[str], text_col: str, schema: pa.Schema, runs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, dropped, cut_chunks = batch.column(text_col).to_pylist(), [], []
            for k, (found, spared) in enumerate(zip(batch.column("__found").to_pylist(), batch.column("__spared").to_pylist(), strict=True)):
                away = {(x["place"], x["end"]) for x in found or () if not x["first"]} - {(x["place"], x["end"]) for x in spared or ()}
                gone = {i for a, b in away for i in range(a, b)}
                if gone:
                    texts[k] = "\n".join([line for i, line in enumerate(texts[k].split("\n")) if i not in gone])
                dropped.append(len(gone))
                cut_chunks.append(sum(i - 1 not in gone for i in gone) if runs else len(away))
            new = {text_col: pa.array(texts, schema.field(text_col).type), "removed_lines": pa.array(dropped, pa.int64()), "removed_chunks": pa.array(cut_chunks, pa.int64())}
            yield pa.record_batch([new[n] if n in new else batch.column(n).cast(schema.field(n).type) for n in names], schema=schema)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """The rows of ``docs`` with repeated chunks, and with ``runs`` all repeated runs of lines, cut out of ``text_col``.

    All columns stay, then come ``removed_lines`` and ``removed_chunks`` (which replace
    columns of those names); with ``runs`` the latter counts runs of removed lines. Null and empty texts stay as they are. Rows with a null id
    come first in the order of places. Repeated rows (one id and one text) count as one
    place and are treated alike; rows with one id and other texts are told apart by a
    hash of the text. A text can become empty. Columns whose names begin with two
    underscores are dropped. An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c for c in docs.columns if not c.startswith("__") and c not in ("removed_lines", "removed_chunks")]
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    keyed = docs.select(*names, F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__row"))
    hashed = cut(K.arrow(keyed.select("__id", "__row", text_col), _hashed(runs), "id long, row long, place int, end int, h1 long, h2 long"))
    place = F.struct("id", "row", "place", "end")
    # grouped by a struct, so that the join below has exchanges of its own, whose large partitions can be split
    groups = hashed.groupBy(F.struct("h1", "h2").alias("h")).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last or first.id is null").select("h.h1", "h.h2", "first")
    own = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.row") == F.col("row"))
    stays = own & F.col("place").between(F.col("first.place"), F.col("first.end") - 1)
    found = hashed.join(groups, ["h1", "h2"]).select("id", "row", F.struct("place", "end", "h1", "h2", stays.alias("first")).alias("one"))
    found = found.groupBy(F.col("id").alias("__i"), F.col("row").alias("__r")).agg(F.array_distinct(F.collect_list("one")).alias("__found"))
    same = lambda a, b: a["__id"].eqNullSafe(b["__i"]) & (a["__row"] == b["__r"])
    marked = keyed.join(found, same(keyed, found), "left").drop("__i", "__r")

    exact = K.arrow(marked, _repeated(text_col), "id long, row long, place int, end int, h1 long, h2 long, chunk string").groupBy("h1", "h2", "chunk").agg(F.min(place).alias("first"))
    # of chunks that share a hash and differ in bytes, each has a first place of its own
    clash = exact.groupBy("h1", "h2").agg(F.min("first").alias("low"), F.collect_list("first").alias("firsts")).where("size(firsts) > 1")
    spared = clash.select(F.explode("firsts").alias("f")).select("f.*").groupBy(F.col("id").alias("__i"), F.col("row").alias("__r")).agg(F.collect_list(F.struct("place", "end")).alias("__spared"))
    ready = marked.join(spared, same(marked, spared), "left").drop("__i", "__r")

    fields = [docs.schema[n] for n in names]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields] + [T.StructField("removed_lines", T.LongType()), T.StructField("removed_chunks", T.LongType())])
    arrow = to_arrow_schema(schema)
    return K.arrow(ready, _removal([f.name for f in schema], text_col, arrow, runs), schema)
