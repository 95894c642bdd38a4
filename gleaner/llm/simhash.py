"""SimHash near-duplicates by pivot distance tables.

Each distinct fingerprint gets, once, its Hamming distances to sixteen reference fingerprints. Two fingerprints within three
bits are within three of each other in every coordinate, so pairs with a larger difference are discarded and survivors are
verified. Pairs meet in files: three bits leave two of five blocks of bits alone whatever they are, so a fingerprint is filed
under the ten pairs of its blocks, and a large file is filed anew by the rest of its bits. Each file returns a forest of its
links, not all pairs, and Spark joins turn the forests into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import textscan
from gleaner.llm.shared import written

SEED = 42
REACH = 3
#: Bytes of text fingerprinted at a time.
BLOCK_BYTES = 2 << 20
#: Fingerprints of a file; larger files are filed anew.
FILE_ROWS = 4096
#: Rows whose pairs are formed at a time.
STEP = 1 << 16


def shingle_bits(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks of rows with their fingerprints (uint64): majority bits of the hashes of all word shingles, repeats included."""
    data, offsets = textscan.utf8(column)
    for i, j in textscan.blocks(offsets, BLOCK_BYTES):
        own, at = textscan.lower(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
        out = np.zeros(j - i, np.uint64)
        starts, ends, docs = textscan.words(own, at)
        if len(starts):
            text, begin = textscan.joined(own, starts, ends)
            stop = begin + (ends - starts)
            n = np.diff(docs)
            count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
            edge = np.concatenate([[0], np.cumsum(count)])
            first = np.arange(edge[-1]) + np.repeat(docs[:-1] - edge[:-1], count)
            last = np.minimum(first + shingle, np.repeat(docs[1:], count)) - 1
            hashes = textscan.xxh64(text, begin[first], stop[last] - begin[first], SEED)
            some = np.flatnonzero(count)
            for part in _chunks(edge[some], edge[some + 1], 1 << 17):
                a, b = edge[some[part[0]]], edge[some[part[-1]] + 1]
                bits = np.unpackbits(hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                sums = np.add.reduceat(bits, edge[some[part]] - a, axis=0, dtype=np.int32)
                set_ = 2 * sums > count[some[part]][:, None]
                out[some[part]] = np.packbits(set_, axis=1, bitorder="little").view("<u8")[:, 0]
        yield i, j, out


def _chunks(lo: np.ndarray, hi: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Runs of rows with `limit` shingles at most together, or one row with more."""
    i = 0
    while i < len(lo):
        j = max(i + 1, int(np.searchsorted(hi, lo[i] + limit, "right")))
        yield np.arange(i, j)
        i = j


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and `fp` (the fingerprint as a signed long) for each row. Texts without a word, and null, have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, bits in shingle_bits(batch.column(1), shingle):
                yield pa.record_batch([batch.column(0)[i:j], pa.array(bits.view(np.int64))], ["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def pivots(n: int = 16) -> list[int]:
    """Reference fingerprints: random ones of a fixed seed, the same in every task."""
    return np.random.default_rng(20).integers(0, 1 << 64, n, np.uint64, endpoint=False).tolist()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distances(rows: DataFrame, fp_col: str = "fp") -> DataFrame:
    """`rows` with the distances of fp_col to the sixteen pivots, a byte each: the first eight in `near`, the others in `far`."""
    each = [F.bit_count(F.col(fp_col).bitwiseXOR(F.lit(_signed(p)))).cast("long") for p in pivots()]
    pack = lambda columns: sum((F.shiftleft(c, 8 * k) for k, c in enumerate(columns[1:], 1)), columns[0])
    return rows.select("*", pack(each[:8]).alias("near"), pack(each[8:]).alias("far"))


def _cut(free: list[int], n: int) -> list[int]:
    """Masks of n runs of the given bits, of sizes as equal as can be."""
    edges = [round(k * len(free) / n) for k in range(n + 1)]
    return [sum(1 << x for x in free[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def masks(level: int = 0) -> list[int]:
    """Bits that fingerprints of a file share: pairs of five blocks; at the next level, for each mask, four that add a quarter of the rest."""
    if level == 0:
        return [a | b for a, b in combinations(_cut(list(range(64)), REACH + 2), 2)]
    return [m | own for m in masks(level - 1) for own in _cut([x for x in range(64) if not m >> x & 1], REACH + 1)]


def links_among(fps: np.ndarray, table: np.ndarray, key: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among fingerprints of equal keys (sorted by key, then by the first coordinate of `table`): (member, root) by index.

    Pairs further apart than `reach` in the first coordinate are never formed, those further apart in any other coordinate
    are discarded, the rest are verified.
    """
    root = np.arange(len(fps))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for low in range(0, len(fps), STEP):
        active = np.arange(low, min(low + STEP, len(fps)))
        shift = 1
        while True:
            active = active[active + shift < len(fps)]
            active = active[(key[active + shift] == key[active]) & (table[active + shift, 0] - table[active, 0] <= reach)]
            if not len(active):
                break
            pair = active
            for columns in (slice(1, 4), slice(4, 16)):
                pair = pair[np.abs(table[pair + shift, columns] - table[pair, columns]).max(axis=1) <= reach] if len(pair) else pair
            pair = pair[np.bitwise_count(fps[pair] ^ fps[pair + shift]) <= reach] if len(pair) else pair
            pair = pair[root[pair] != root[pair + shift]] if len(pair) else pair
            for i in pair.tolist():
                a, b = find(i), find(i + shift)
                if a != b:
                    root[max(a, b)] = min(a, b)
            if len(pair):  # all point at their roots again
                while len(moved := np.flatnonzero(root[root] != root)):
                    root[moved] = root[root[moved]]
            shift += 1
    member = np.flatnonzero(root != np.arange(len(fps)))
    return member, root[member]


def _files(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links of complete files; rows: key, fp, near, far."""
    if rows.shape[1] < 2:
        return
    first = rows[2] & 0xFF
    rows = rows[:, np.lexsort((first, rows[0]))]
    alone = np.concatenate([[True], rows[0, 1:] != rows[0, :-1], [True]])
    rows = rows[:, ~(alone[:-1] & alone[1:])]
    if rows.shape[1]:
        fps = rows[1].view(np.uint64)
        table = np.ascontiguousarray(rows[2:4].T).view(np.int8)
        member, root = links_among(fps, table, rows[0])
        if len(member):
            yield pa.record_batch([fps[member].view(np.int64), fps[root].view(np.int64)], ["a", "b"])


def _links(filed: DataFrame) -> DataFrame:
    """Links (a, b) of all files, each a key's rows (key, fp, near, far), at most about FILE_ROWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in range(4)])
            if not rows.shape[1]:
                continue
            whole = int(np.searchsorted(rows[0], rows[0, -1], "left"))  # the last file may go on in the next batch
            if whole:
                yield from _files(np.concatenate([*held, rows[:, :whole]], axis=1))
                held = []
            held.append(rows[:, whole:])
        if held:
            yield from _files(np.concatenate(held, axis=1))

    return filed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def forests(table: DataFrame) -> DataFrame:
    """Links (a, b) among rows of `distances` (fp, near, far), as forests of files; over all files they connect what is to be connected.

    Files are counted before their rows are shuffled. Those over FILE_ROWS, such as families of templates make, are filed by
    longer keys until they are small: a file of distinct fingerprints can't be larger than the number of values of the bits
    that its key leaves open, so this ends.
    """
    rows, level, links = table.select("fp", "near", "far", F.array(*[F.lit(k) for k in range(len(masks()))]).alias("of")), 0, None
    while True:
        own = F.array(*[F.lit(_signed(m)) for m in masks(level)])
        filed = rows.select("fp", "near", "far", F.explode("of").alias("k"))
        filed = filed.withColumn("key", F.xxhash64("k", F.get(own, F.col("k")).bitwiseAND(F.col("fp"))))
        large = written(filed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > FILE_ROWS).select("key"), "large")
        again = large.limit(1).count() > 0
        small = filed.join(large, "key", "left_anti") if again else filed
        found = written(_links(small.select("key", "fp", "near", "far")), "forest")
        links = found if links is None else links.unionByName(found)
        if not again:
            return links
        children = F.transform(F.sequence(F.lit(0), F.lit(REACH)), lambda j: F.col("k") * (REACH + 1) + j)
        rows = written(filed.join(large, "key", "left_semi").select("fp", "near", "far", children.alias("of")), "refiled")
        level += 1


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): root is the least node of its component.

    Large-star and small-star rounds until nothing changes: links point ever nearer to the least node until all point at it.
    What a node's links are joined with is a written table, so that Spark can split the links of a hub.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    sign = _sign(edges)
    while sign[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m")), "least")
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a")
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = written(small, "links")
        now = _sign(edges)
        if now == sign:
            break
        sign = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def grouped(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, fingerprint (16 hex digits), component_id (the smallest id that links of three bits or fewer reach), fp.

    Rows with null ids are linked like others but give no component its id; a component of such rows alone has null. Null
    and empty texts have fingerprint zero and are linked by it. Repeated rows are rows of their own. An empty table gives an
    empty result. Copies meet as one fingerprint first, so a group of copies of any size costs no more than one row later.
    """
    given = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = written(fingerprints(given, shingle, "__id", "__text"), "fingerprints")
    distinct = written(distances(rows.groupBy("fp").agg(F.min("__id").alias("least"))), "distances")
    roots = components(forests(distinct))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named, "roots")
    # written, so that the rows of a large component's root can be split in the join
    ids = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    of = named.join(ids, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(of, "fp").select(F.col("__id").alias(id_col), hexed.alias("fingerprint"), "component_id", "fp")


def kept(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs` with one row of each group of copies or near copies: that with the group's smallest id.

    Groups are those of `grouped` and of `jaccard.alike` together: a row goes if either has a row before it. Rows are told by
    id and text (its hash), so rows that share an id but not a text are each judged by their own text; the one of the smaller
    hash comes first, and rows without an id come after all others. Null and empty texts are one group; of rows that repeat
    both id and text one stays. An empty table stays empty, and all columns stay.
    """
    from gleaner.llm import jaccard  # which needs this module

    own_names = {n: f"__c{i}" for i, n in enumerate(docs.columns)}  # whatever `docs` calls its columns
    own = docs.toDF(*own_names.values())
    id_, text = F.col(own_names[id_col]), F.coalesce(F.col(own_names[text_col]), F.lit(""))
    key = F.struct(id_.isNull().alias("last"), id_.alias("id"), F.xxhash64(text).alias("h"))
    keyed = own.select(key.alias("key"), text.alias("text"))
    strict = grouped(keyed, 3, "key", "text").select("key", "component_id")
    wide = jaccard.alike(keyed, shingle, similarity, "key", "text").select("key", "component_id")
    marks = strict.unionByName(wide).groupBy("key").agg(F.min("component_id").alias("least"), F.count("*").alias("n"))
    marks = written(marks, "marks")
    heads = marks.where(F.col("key") == F.col("least")).select(F.col("key.id").alias("id"), F.col("key.h").alias("h"))
    # the number of heads follows that of documents: a merge join at every size, not a broadcast while they are few
    chosen = own.join(heads.hint("merge"), id_.eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("h")), "left_semi")
    if marks.where("n > 2").limit(1).count():
        chosen = chosen.withColumn("h", F.xxhash64(text)).dropDuplicates([own_names[id_col], "h"])
    return chosen.select(*[F.col(c).alias(n) for n, c in own_names.items()])
