"""Near copies by the Jaccard similarity of word shingles: an exact prefix-filter join, verified on whole sets.

Two sets that are similar enough share one of their first elements in any order that holds for all sets. Sets are filed
under those, common shingles last. Pairs that meet too seldom to be similar are dropped, the rest are verified. Large
groups are first joined by links to a few of their members, and then only pairs of different groups are looked at; so no
link is lost that components need, and a group of near copies costs no square of its size. A large file is cut into blocks,
and each pair of its blocks meets in a task of its own. What stays square is a file of many unlike sets, as a shingle makes
that is rare in the sample yet stands among the rarest of many texts: its blocks all meet, and parity bits drop most pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import textscan
from gleaner.llm.shared import written
from gleaner.llm.simhash import SEED, components

#: Bytes of text cut into shingles at a time.
BLOCK_BYTES = 1 << 20
#: Texts, about, in which common shingles are counted, how often one must be there, and how many at most are put last. They
#: decide the order of shingles alone: any order finds all pairs.
SAMPLE, OFTEN, COMMON = 20_000, 3, 200_000
#: Members of a file, about, that all others of it are tried against, and files of common shingles for each set, in the first pass.
HUBS, FILES = 3, 6
#: Bits (a power of two, of 64 at least) by whose parity two sets are told apart before they are compared.
ODD_BITS = 256
#: Sets of a file; a larger one is cut into blocks.
FILE_SETS = 20_000
#: Pairs returned at a time, and bits (a power of two) of the map of sets that are to be verified.
PAIRS, MAP_BITS = 1 << 17, 1 << 25
#: Sets whose repetition a task remembers.
SEEN = 1 << 17


def sets_of(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Blocks of rows with their sets of shingle hashes (ascending uint64). A text of fewer words is one shingle."""
    data, offsets = textscan.utf8(column)
    for i, j in textscan.blocks(offsets, BLOCK_BYTES):
        own, at = textscan.lower(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
        starts, ends, docs = textscan.words(own, at)
        if not len(starts):
            yield i, j, [np.empty(0, np.uint64)] * (j - i)
            continue
        text, begin = textscan.joined(own, starts, ends)
        stop = begin + (ends - starts)
        n = np.diff(docs)
        count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
        edge = np.concatenate([[0], np.cumsum(count)])
        first = np.arange(edge[-1]) + np.repeat(docs[:-1] - edge[:-1], count)
        last = np.minimum(first + shingle, np.repeat(docs[1:], count)) - 1
        hashes = textscan.xxh64(text, begin[first], stop[last] - begin[first], SEED)
        yield i, j, [np.unique(hashes[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _ceil(n: np.ndarray | int, share: Fraction) -> np.ndarray | int:
    return -(-n * share.numerator // share.denominator)


def _common(docs: DataFrame, shingle: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles (ascending) and their counts in a sample of texts, chosen by a hash of the text."""
    share = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets in sets_of(batch.column(0), shingle):
                yield pa.record_batch([np.concatenate(sets).view(np.int64)], ["h"])

    sample = docs.where(F.pmod(F.xxhash64(text_col), F.lit(share)) == 0).select(text_col)
    often = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    rows = often.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _filed(sets: DataFrame, common, share: Fraction, hot: bool) -> DataFrame:
    """(key, node, own, n, rare, bits) for the first shingles of each set by rarity; if `hot`, for a few common ones only.

    `own` is the set's group, `n` its size, `rare` how many of its shingles are not common ones. `bits` has, for each value of
    a shingle's last bits, whether the set has an odd number of such shingles; rows of common shingles alone carry it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = common.value
        for batch in batches:
            node, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys, often, rare, total, odd = [], [], [], [], []
            for raw in batch.column(2):
                x = np.frombuffer(raw.as_buffer(), np.uint64)
                size = len(x)
                first = size - _ceil(size, share) + 1 if size else 0
                at = np.minimum(np.searchsorted(h, x), max(len(h) - 1, 0))
                count = np.where(h[at] == x, n[at], 0) if len(h) else np.zeros(size, np.int64)
                order = np.argsort(count, kind="stable")[:first]  # x ascends: equal counts by hash
                order = order[count[order] > 0][:FILES] if hot else order
                keys.append(x[order])
                often.append(count[order] > 0)
                rare.append(int((count == 0).sum()))
                total.append(size)
                odd.append(np.packbits(np.bincount((x & np.uint64(ODD_BITS - 1)).astype(np.int64), minlength=ODD_BITS) & 1 == 1, bitorder="little"))
            size = np.array([len(x) for x in keys], np.int64)
            if not size.sum():
                continue
            total, rare, odd = np.array(total, np.int32), np.array(rare, np.int32), np.array(odd)
            for part in np.array_split(np.arange(len(keys)), max(1, int(size.sum()) // PAIRS)):
                if size[part].sum():
                    k = np.concatenate([keys[p] for p in part.tolist()]).view(np.int64)
                    each = lambda values, part=part: np.repeat(values[part], size[part], axis=0)
                    with_bits = np.concatenate([often[p] for p in part.tolist()]) & (not hot)
                    yield pa.record_batch([k, each(node), each(own), each(total), each(rare), _binary(each(odd), with_bits)], ["key", "node", "own", "n", "rare", "bits"])

    return sets.select("node", "own", "hashes").mapInArrow(run, "key long, node long, own long, n int, rare int, bits binary")


def _binary(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column; null where not valid."""
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum(valid * rows.shape[1], out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(rows), [pa.py_buffer(np.packbits(valid, bitorder="little").tobytes()), pa.py_buffer(ends.tobytes()), pa.py_buffer(rows[valid].tobytes())])


def _columns(batch: pa.RecordBatch, longs: tuple[str, ...]) -> np.ndarray:
    """Columns of integers and, below, the four words of `bits` (0 for null), as rows of int64."""
    bits = np.zeros((batch.num_rows, ODD_BITS // 64), np.int64)
    column = batch.column(batch.schema.get_field_index("bits"))
    there = column.is_valid().to_numpy(zero_copy_only=False)
    some = column.drop_null()
    if len(some):
        _, ends, data = some.buffers()
        start = np.frombuffer(ends, np.int32)[some.offset]
        bits[there] = np.frombuffer(data, np.uint8)[start : start + len(some) * ODD_BITS // 8].view(np.int64).reshape(len(some), -1)
    named = [batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in longs]
    return np.concatenate([np.stack(named), bits.T])


def _fits(a: str, b: str, share: Fraction) -> Column:
    """Whether the sizes of two sets allow a link."""
    return F.least(a, b) * share.denominator >= F.greatest(a, b) * share.numerator


def _tried(filed: DataFrame, share: Fraction) -> DataFrame:
    """(a, b) for each set b: of the few members of its files that all are tried against, that which it meets most.

    The members are those with the fewest rare shingles, as an original among edited copies has, told apart by HUBS hashes;
    so they come from one aggregation, and a file that a third of all sets are in meets them in a join that Spark can split.
    """
    filed = written(filed.select("key", "node", "n", (F.col("rare") / F.col("n")).alias("odd")), "files")
    order = [F.struct("odd" if not k else F.floor(F.col("odd") * 10), F.xxhash64("node", F.lit(k))) for k in range(HUBS)]
    least = [F.min_by(F.struct("node", "n", "odd"), order[k]).alias(f"m{k}") for k in range(HUBS)]
    few = filed.groupBy("key").agg(F.count("*").alias("c"), *least).where("c > 1")
    few = few.select("key", F.explode(F.array_distinct(F.array(*[f"m{k}" for k in range(HUBS)]))).alias("m"))
    few = written(few.select("key", F.col("m.node").alias("a"), F.col("m.n").alias("na"), F.col("m.odd").alias("oa")), "members")
    met = filed.join(few, "key").where((F.col("a") != F.col("node")) & _fits("na", "n", share))
    met = met.groupBy("a", "oa", F.col("node").alias("b")).agg(F.count("*").alias("c"))
    return met.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("oa"), "a")).alias("a")).select("a", "b")


MET = "a long, b long, na int, nb int, own long, bits binary"


def _met(filed: DataFrame, share: Fraction) -> DataFrame:
    """(a, b, na, nb): pairs of sets of different groups that stand in one file, once for each file, if their sizes allow a link."""
    limit = FILE_SETS
    longs = ("key", "node", "own", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, large = np.empty((len(longs) + ODD_BITS // 64, 0), np.int64), None
        for batch in batches:
            rest = np.concatenate([rest, _columns(batch, longs)], axis=1)
            if not rest.shape[1]:
                continue
            whole = int(np.searchsorted(rest[0], rest[0, -1], "left"))  # the last file may go on
            for part in (rest[:, :whole], rest[:, whole:] if rest.shape[1] - whole > limit else rest[:, :0]):
                small, over = _by_size(part, large, limit)
                yield from _pairs(small, share)
                if over.shape[1]:
                    large = int(over[0, -1])
                    yield _as_filed(over)
            rest = rest[:, whole:] if rest.shape[1] - whole <= limit else rest[:, :0]
        small, over = _by_size(rest, large, limit)
        yield from _pairs(small, share)
        if over.shape[1]:
            yield _as_filed(over)

    out = written(filed.repartition("key").sortWithinPartitions("key").mapInArrow(run, MET), "met")
    pairs = out.where("own IS NULL").drop("own", "bits")
    over = out.where("own IS NOT NULL").select(F.col("a").alias("key"), F.col("b").alias("node"), "own", F.col("na").alias("n"), "bits")
    if not over.limit(1).count():
        return pairs
    over = over.distinct()  # a set that several tasks have filed
    sizes = written(over.groupBy("key").agg(F.ceil(F.count("*") / limit).cast("int").alias("blocks")), "sizes")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    blocks = over.join(sizes, "key").withColumn("block", own)
    ends = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("low"), F.greatest(o, F.col("block")).alias("high")))
    dealt = blocks.select("key", "node", "own", "n", "bits", "block", F.explode(ends).alias("e"))
    dealt = dealt.select(F.xxhash64("key", "e.low", "e.high").alias("key"), "node", "own", "n", F.when(F.col("e.low") == F.col("e.high"), -1).otherwise(F.col("block")).alias("block"), "bits")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_longs = (*longs, "block")
        rest = np.empty((len(own_longs) + ODD_BITS // 64, 0), np.int64)
        for batch in batches:
            rest = np.concatenate([rest, _columns(batch, own_longs)], axis=1)
            whole = int(np.searchsorted(rest[0], rest[0, -1], "left")) if rest.shape[1] else 0
            yield from _pairs(np.delete(rest[:, :whole], 4, axis=0), share, rest[4, :whole])
            rest = rest[:, whole:]
        yield from _pairs(np.delete(rest, 4, axis=0), share, rest[4])

    more = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(meet, MET)
    return pairs.unionByName(more.drop("own", "bits"))


def _as_filed(rows: np.ndarray) -> pa.RecordBatch:
    """Rows of large files as they came in (key, node, n, -1, own, bits), to be filed anew."""
    words = np.ascontiguousarray(rows[4:].T).view(np.uint8).reshape(rows.shape[1], -1)
    return _batch_of(rows[0], rows[1], rows[3], np.full(rows.shape[1], -1), rows[2], _binary(words, np.ones(rows.shape[1], bool)))


def _by_size(rows: np.ndarray, large: int | None, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of files to be paired here, and of large files: those of more than `limit` rows, and the one known to be large."""
    key = rows[0]
    if not len(key):
        return rows, rows
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    many = np.repeat(np.diff(edge), np.diff(edge))
    over = many > limit
    if large is not None:
        over |= key == large
    return rows[:, ~over], rows[:, over]


def _pairs(rows: np.ndarray, share: Fraction, block: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Pairs of complete files; rows: key, node, own, n and the words of `bits`. With `block`, of different blocks alone where it is not negative.

    Two sets differ in at least as many shingles as their bits do, so pairs whose bits differ too much are no links.
    """
    order = np.lexsort((rows[1], rows[0]))
    rows, block = rows[:, order], block if block is None else block[order]
    if rows.shape[1]:  # a set that several tasks have filed
        once = np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])
        rows, block = rows[:, once], block if block is None else block[once]
    key, node, own, n = rows[:4]
    bits = np.ascontiguousarray(rows[4:].T).view(np.uint64)
    p, q = share.numerator, share.denominator
    out, held = [], 0
    active, shift = np.arange(len(key)), 1
    while len(active):
        active = active[active + shift < len(key)]
        active = active[key[active] == key[active + shift]]
        left, right = active, active + shift
        ok = (own[left] != own[right]) & (np.minimum(n[left], n[right]) * q >= np.maximum(n[left], n[right]) * p)
        if block is not None:
            ok &= (block[left] < 0) | (block[left] != block[right])
        left, right = left[ok], right[ok]
        # a link differs in at most (q - p) / (q + p) of the shingles of both
        ok = np.bitwise_count(bits[left] ^ bits[right]).sum(axis=1, dtype=np.int64) * (q + p) <= (q - p) * (n[left] + n[right])
        left, right = left[ok], right[ok]
        if len(left):
            out.append(np.stack([node[left], node[right], n[left], n[right]]))
            held += len(left)
        if held >= PAIRS:
            yield _batch_of(*np.concatenate(out, axis=1))
            out, held = [], 0
        shift += 1
    if out:
        yield _batch_of(*np.concatenate(out, axis=1))


def _batch_of(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, own: np.ndarray | None = None, bits: pa.Array | None = None) -> pa.RecordBatch:
    rest = [pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())] if own is None else [pa.array(own), bits]
    return pa.record_batch([pa.array(a), pa.array(b), pa.array(na.astype(np.int32)), pa.array(nb.astype(np.int32)), *rest], ["a", "b", "na", "nb", "own", "bits"])


def _map(pairs: DataFrame) -> np.ndarray:
    """A bit map, of one size whatever the number of pairs, of their sets; a few others pass it."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    words = nodes.selectExpr(f"(node & {MAP_BITS - 1}) >> 5 AS w", "shiftleft(1L, CAST(node & 31 AS INT)) AS bit")
    rows = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 32, np.uint32)
    out[rows["w"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return out


def _among(sets: DataFrame, pairs: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of sets that the map of `pairs` passes, or all others: sets are wide, and only those that must be are shuffled."""
    seen = sets.sparkSession.sparkContext.broadcast(_map(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy() & (MAP_BITS - 1)
            yield batch.filter(pa.array(((seen.value[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1) == inside))

    return sets.select("node", "hashes").mapInArrow(run, "node long, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of `share` or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both * share.denominator >= share.numerator * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    found = written(_among(sets, pairs).dropDuplicates(["node"]), "asked")
    both = pairs.join(found.toDF("a", "x").hint("merge"), "a").join(found.toDF("b", "y").hint("merge"), "b")
    return written(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "verified")


def alike(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, component_id: groups that links of texts with a Jaccard similarity of `similarity` or more connect.

    The similarity is that of the sets of `shingle` words of the whole texts. Nulls, empty texts and repeated rows are
    treated as in `simhash.grouped`.
    """
    share = Fraction(str(similarity))
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(_common(docs, shingle, text_col))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for i, j, sets in sets_of(batch.column(1), shingle):
                raw = [x.tobytes() for x in sets]
                flat = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
                at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
                node = textscan.xxh64(flat, at[:-1], np.diff(at), SEED).view(np.int64)
                for k, x in enumerate(node.tolist()):  # copies in a task carry their set once
                    if x in seen:
                        raw[k] = None
                    elif len(seen) < SEEN:
                        seen.add(x)
                yield pa.record_batch([batch.column(0)[i:j], pa.array(node), pa.array(raw, pa.binary())], ["id", "node", "hashes"])

    rows = written(docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, node long, hashes binary"), "sets")
    sets = rows.where(F.col("hashes").isNotNull()).select("node", "hashes")

    # groups: links of sets to a few members of the files of common shingles, for each set to those it meets most
    tried = _tried(_filed(sets.withColumn("own", F.col("node")), common, share, True), share)
    hubs = _verified(written(tried, "tried"), sets, share)
    roots = components(hubs)

    # pairs of different groups: all that may be similar
    inner = _among(sets, hubs).join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("own"), "hashes")
    grouped = inner.unionByName(_among(sets, hubs, False).withColumn("own", F.col("node")))
    met = _met(_filed(grouped, common, share, False), share)
    p, q = share.numerator, share.denominator
    least = F.ceil((F.col("na") + F.col("nb")) * F.lit(p) / F.lit(p + q) - 1e-6) - F.ceil(F.greatest("na", "nb") * F.lit(p) / F.lit(q) - 1e-6) + 1
    met = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("a", "b")
    roots = components(hubs.unionByName(_verified(written(met, "candidates"), sets, share)))

    distinct = rows.groupBy("node").agg(F.min("id").alias("least"))
    named = written(distinct.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "roots")
    ids = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    of = named.join(ids, "root").select("node", "component_id")
    return rows.select(F.col("id").alias(id_col), "node").join(of, "node").select(id_col, "component_id")
