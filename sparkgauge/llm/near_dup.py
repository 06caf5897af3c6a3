"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set holds its distinct five-word shingles (ASCII letters lower-cased; a
text of one to four words is one shingle; a text without words has an empty set). Its
signature has ``COORDINATES`` coordinates, each one a hash of ``ROWS`` min-wise values
of the set, so two sets of Jaccard similarity J agree in a coordinate with probability
J**ROWS. Sets are posted under their coordinate values. A pair that agrees in at least
``MATCHES`` coordinates must meet in one of the first ``COORDINATES - MATCHES + 1``, so
only this prefix is posted (nothing is lost by it), and a pair is confirmed on its full
sets only after its collisions have been counted up to ``MATCHES``. At J = 0.85 a pair
has fewer than 4 of 24 collisions with a probability of about one in a million, at
J = 0.8 of about one in 11,000.

Groups of copies stay linear. Equal sets are merged before anything is posted. In each
posting list the set with the most company is the centre: all others are confirmed
against it alone. Only lists whose members are then still in different components are
compared further: block against block, across components, each two blocks once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.checkpoints import cut
from sparkgauge.llm import kernels as K
from sparkgauge.operators.graph import connected_components, spread_join

SHINGLE = 5
COORDINATES, ROWS, MATCHES = 24, 3, 4
#: Sets and shingles in a block, about; a larger set is a block by itself.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
_A = K.mix(np.arange(1, COORDINATES * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_X = K.mix(_A * np.uint64(0xE7037ED1A0B428DB))


def shingle_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(all shingle hashes, first of each text) for consecutive slices of the texts."""
    raw, at = K.utf8(column)
    for i, j in K.slices(at):
        part, own = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        start, end, first = K.words(part, own)
        yield K.shingles(K.word_hashes(part, start, end), first, SHINGLE)


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of coordinates for each set; sets must not be empty."""
    low = np.empty((COORDINATES * ROWS, len(at) - 1), np.uint64)
    for k in range(len(low)):
        low[k] = np.minimum.reduceat((hashes ^ _X[k]) * _A[k], at[:-1])
    out = np.zeros((COORDINATES, len(at) - 1), np.uint64)
    for r in range(ROWS):
        out = K.mix(out * np.uint64(31) + low[r::ROWS])
    return (out ^ K.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))[:, None]).T.astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("print", pa.binary()), ("coords", pa.list_(pa.int64()))])
    for batch in batches:
        n, prints, coords = [], [], []
        for hashes, at in shingle_sets(batch.column(1)):
            full = np.flatnonzero(np.diff(at))
            if len(full):
                signed = iter(signatures(hashes, np.append(at[full], at[-1])))
            for i in range(len(at) - 1):
                own = np.unique(hashes[at[i] : at[i + 1]])
                n.append(len(own))
                prints.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                coords.append(next(signed) if len(own) else None)
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(coords, kind.field(3).type)], schema=kind)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("id", pa.int64()), ("coords", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])
    for batch in batches:
        ids, at0 = batch.column(0), 0
        for hashes, at in shingle_sets(batch.column(1)):
            sets = [np.unique(hashes[at[i] : at[i + 1]]).astype(np.int64) for i in range(len(at) - 1)]
            full = np.flatnonzero(np.diff(at))
            signed = iter(signatures(hashes, np.append(at[full], at[-1]))) if len(full) else iter(())
            coords = [next(signed) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.record_batch([ids.slice(at0, len(sets)), pa.array(coords, kind.field(1).type), pa.array(sets, kind.field(2).type)], schema=kind)
            at0 += len(sets)


def _agree(a: str, b: str):
    """The coordinates in which two signatures agree."""
    return F.filter(F.transform(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda x, i: F.when(x["a"] == x["b"], i)), lambda i: i.isNotNull())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose collisions reach MATCHES and whose full sets reach the similarity."""
    left = sets.select(F.col("id").alias("u"), F.col("coords").alias("cu"), F.col("shingles").alias("su"))
    right = sets.select(F.col("id").alias("v"), F.col("coords").alias("cv"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    fits = 100 * both >= percent * (F.size("su") + F.size("sv") - both)
    near = (100 * F.least(F.size("su"), F.size("sv")) >= percent * F.greatest(F.size("su"), F.size("sv"))) & (F.size(_agree("cu", "cv")) >= MATCHES)
    pairs = cut(pairs, 250_000)  # a centre's members are dealt to many tasks, and its set is repeated there
    return spread_join(pairs.join(left, "u"), right, "v", pairs.count(), pairs).where(near).where(fits).select("u", "v").distinct()


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Intersection sizes of the sets a[rows] and b[cols]."""
    if len(rows) <= 2000:
        return np.array([np.intersect1d(a[i], b[j], assume_unique=True).size for i, j in zip(rows, cols)], np.int64)
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, term, often = np.unique(flat, return_inverse=True, return_counts=True)
    keep = often[term] > 1
    term, owner = np.unique(term[keep], return_inverse=True)[1], owner[keep]
    order = np.argsort(term, kind="stable")
    term, owner = term[order], owner[order]
    total = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int(term[-1]) + 1 if len(term) else 0, 1024):
        i, j = np.searchsorted(term, [low, low + 1024])
        grid = np.zeros((len(a) + len(b), 1024), np.float32)
        grid[owner[i:j], term[i:j] - low] = 1
        total += grid[: len(a)] @ grid[len(a) :].T
    return total[rows, cols].astype(np.int64)


def _compare(percent: int):
    """Links across components between the two blocks of a group, or within its only block."""

    def run(table: pa.Table) -> pa.Table:
        at = [np.flatnonzero(table["side"].to_numpy() == s) for s in (0, 1)]
        ids, component = table["id"].to_numpy(), table["component"].to_numpy()
        sets = [np.asarray(x) for x in table["shingles"].combine_chunks().to_numpy(zero_copy_only=False)]
        signs = np.stack([np.asarray(x) for x in table["coords"].combine_chunks().to_numpy(zero_copy_only=False)])
        a, b = at[0], at[1] if len(at[1]) else at[0]
        hits = np.zeros((len(a), len(b)), np.int16)
        for k in range(COORDINATES):
            hits += signs[a, k][:, None] == signs[b, k][None, :]
        open_ = (hits >= MATCHES) & (component[a][:, None] != component[b][None, :])
        if a is b:
            open_ &= np.arange(len(a))[:, None] < np.arange(len(b))
        rows, cols = np.nonzero(open_)
        both = _overlaps([sets[i] for i in a], [sets[i] for i in b], rows, cols)
        size = np.array([len(x) for x in sets])
        fit = 100 * both >= percent * (size[a[rows]] + size[b[cols]] - both)
        return pa.table({"u": pa.array(ids[a[rows[fit]]], pa.int64()), "v": pa.array(ids[b[cols[fit]]], pa.int64())})

    return run


def _across(live: DataFrame, centres: DataFrame, label: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links between sets that meet in a posting list but are in different components.

    Sets go to blocks of about BLOCK sets or BLOCK_SHINGLES shingles, by the weightiest
    centre of their lists. Every two blocks that meet in a list with more than one
    component between them are compared once, in a group of their own. No pair of sets
    leaves its group unless it is a link.
    """
    named = live.join(label.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    open_ = cut(named.join(mixed, "key").join(centres.select("key", "top"), "key"), 250_000)
    homes = open_.groupBy("id").agg(F.first("component").alias("component"), F.max("top").getField("col2").alias("home"))
    members = homes.join(full.select("id", F.size("shingles").alias("n")).groupBy("id").agg(F.max("n").alias("n")), "id")
    needs = members.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    placed = cut(members.join(needs, "home").select("id", "component", F.struct("home", F.pmod(F.xxhash64("id"), "blocks").alias("part")).alias("block")))
    inside = open_.select("key", "id").join(placed, "id")
    met = inside.groupBy("key", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    a, b = (met.select("key", *(F.col(c).alias(f"{s}_{c}") for c in ("block", "low", "high"))) for s in "ab")
    one = (F.col("a_low") == F.col("a_high")) & (F.col("b_low") == F.col("b_high")) & (F.col("a_low") == F.col("b_low"))
    meetings = a.join(b, "key").where((F.col("a_block") <= F.col("b_block")) & ~one).select("key", "a_block", "b_block")
    sides = F.when(F.col("a_block") == F.col("b_block"), F.array(F.struct(F.lit(0).alias("side"), F.col("a_block").alias("block")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("a_block").alias("block")), F.struct(F.lit(1).alias("side"), F.col("b_block").alias("block")))
    )
    # of a block, only the sets in lists that both blocks meet in are seated
    seats = meetings.select("key", "a_block", "b_block", F.inline(sides)).join(inside, ["key", "block"]).select("a_block", "b_block", "side", "id", "component").distinct()
    return seats.join(full, "id").groupBy("a_block", "b_block").applyInArrow(_compare(percent), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Ids with 100 * intersection >= ``percent`` * union of their sets are linked;
    ``component_id`` is the smallest id reachable and ``kept`` marks it. Rows with one
    id count as one document: its links are those of all its texts, and each row shows
    its own ``n_shingles``. Null and empty texts have no links. A row with a null id has
    no links, a null component and is kept. Other columns are ignored. An empty table
    gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = cut(K.arrow(texts, _sketch, "doc_id long, n_shingles long, print binary, coords array<long>"), 20_000)
    known = sketched.where("doc_id is not null and print is not null")
    # grouped by a struct, so that the join below has exchanges of its own, whose large partitions can be split
    sets = known.groupBy(F.struct("print").alias("p")).agg(F.min("doc_id").alias("id"), F.first("coords").alias("coords")).select("p.print", "id", "coords")
    copied = sketched.select("doc_id", "n_shingles", "print").join(sets.select("print", "id"), "print", "left")
    # an id with several texts is linked to the representatives of all its sets
    owned = copied.where("doc_id is not null and id is not null").select("doc_id", "id")
    several = owned.groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("doc_id")
    same = owned.join(several, "doc_id").where("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v")).distinct()

    posted = sets.select("id", F.explode(F.slice("coords", 1, COORDINATES - MATCHES + 1)).alias("key"))
    company = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = cut(posted.join(company, "key").select("key", "id", "n"), 250_000)
    weight = live.groupBy("id").agg(F.sum("n").alias("weight"))
    members = live.join(weight, "id").select("key", "id", "weight")
    centres = members.groupBy("key").agg(F.max(F.struct("weight", -F.col("id"))).alias("top")).select("key", "top", (-F.col("top.col2")).alias("v"))
    spokes = live.join(centres.drop("top"), "key").where("id <> v").select(F.col("id").alias("u"), "v").distinct()

    involved = weight.select(F.col("id").alias("doc_id"))
    full = cut(K.arrow(texts.join(involved, "doc_id", "left_semi"), _full_sets, "id long, coords array<long>, shingles array<long>").where(F.size("shingles") > 0), 5_000)
    links = cut(_confirmed(spokes, full, percent), 250_000)
    label = cut(connected_components(links), 250_000)

    more = _across(live, centres, label, full, percent)

    label = connected_components(links.unionByName(more).unionByName(same)).withColumnRenamed("node", "id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return copied.join(label, "id", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
