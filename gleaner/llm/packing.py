"""Best-fit packing of documents' tokens into sequences: exact complements first, best fit for the rest.

A plan needs only how many pieces there are of each length, at most `capacity` numbers whatever the corpus, so it is made
once on the driver; Spark counts the lengths, ranks the pieces of a length and puts each at the place of its rank.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import written
from gleaner.llm.tokens import library_pieces


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32. Only documents longer than `capacity` are cut; the first piece takes the remainder.

    Every document ends with `end_id`; a null or empty text is that id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, p in library_pieces(batch.column(1), path):
                ids, at = p.tokens()
                owner, piece, start, length, crc = [], [], [], [], []
                for k in range(j - i):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
                    first = len(own) % capacity or capacity
                    edges = [0, *range(first, len(own) + 1, capacity)]
                    for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        owner.append(i + k)
                        piece.append(n)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own[a:b]))
                yield pa.record_batch([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


class SumIndex:
    """Sums of one, two and three lengths, by hash: which lengths make a sum, the longest first, while pieces of them are left.

    `singles[s]`, `pairs[s]` and `triples[s]` hold the longest length of each such combination; the rest of a pair is the
    difference, the rest of a triple a pair of the difference. Entries whose lengths have run out are dropped when a look-up
    meets them; counts only fall, so they never come back.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.have = dict(counts)
        lengths = np.array(sorted(x for x, n in counts.items() if n > 0), np.int64)
        self.singles = {int(x): [int(x)] for x in lengths}
        a, b = (x.reshape(-1) for x in np.meshgrid(lengths, lengths, indexing="ij"))
        fits = (a >= b) & (a + b <= capacity)
        self.pairs = self._by_sum(a[fits] + b[fits], a[fits])
        a, b = (x.reshape(-1) for x in np.meshgrid(lengths, np.array(sorted(self.pairs), np.int64), indexing="ij"))
        # the longest of three is at least a third of the sum
        fits = (a + b <= capacity) & (2 * a >= b)
        self.triples = self._by_sum(a[fits] + b[fits], a[fits])

    @staticmethod
    def _by_sum(sums: np.ndarray, longest: np.ndarray) -> dict[int, list[int]]:
        order = np.lexsort((longest, sums))  # ascending: the longest is at the end of its list
        sums, longest = sums[order], longest[order]
        edge = np.flatnonzero(np.concatenate([[True], sums[1:] != sums[:-1], [True]])) if len(sums) else np.zeros(1, np.int64)
        return {int(sums[i]): longest[i:j].tolist() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)}

    def _left(self, length: int, taken: tuple[int, ...]) -> bool:
        return self.have.get(length, 0) > taken.count(length)

    def single(self, total: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        return (total,) if total in self.singles and self._left(total, taken) else None

    def pair(self, total: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        entries = self.pairs.get(total, [])
        for k in range(len(entries) - 1, -1, -1):
            a = entries[k]
            if not (self._left(a, ()) and self._left(total - a, (a,))):
                del entries[k]  # near the end of the list: what a look-up drops it does not move
            elif self._left(a, taken) and self._left(total - a, (*taken, a)):
                return (a, total - a)
        return None

    def triple(self, total: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        entries = self.triples.get(total, [])
        for k in range(len(entries) - 1, -1, -1):
            a = entries[k]
            if not self._left(a, ()) or not self.pairs.get(total - a):
                del entries[k]
            elif self._left(a, taken) and (rest := self.pair(total - a, (*taken, a))):
                return (a, *rest)
        return None

    def filling(self, gap: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        """One, two or three lengths that add up to `gap`, besides the pieces `taken`."""
        return self.single(gap, taken) or self.pair(gap, taken) or self.triple(gap, taken)

    def use(self, lengths: tuple[int, ...]) -> int:
        """Takes as many such combinations as counts allow, and returns how many."""
        times = min(self.have[x] // lengths.count(x) for x in set(lengths))
        for x in lengths:
            self.have[x] -= times
        return times


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequences, each as (lengths, how many such), that use up `counts` pieces of each length.

    From the longest length down, a gap is closed exactly by one, two or three lengths whose sum the index has, as often as
    their counts allow; what has no exact complement goes by best fit.
    """
    index = SumIndex(counts, capacity)
    have, out = index.have, []
    for length in sorted(index.singles, reverse=True):
        while have[length] > 0:
            rest = () if length == capacity else index.filling(capacity - length, (length,))
            if rest is None:
                break
            out.append(((length, *rest), index.use((length, *rest))))
    left = sorted(x for x, n in have.items() if n > 0)
    while left:
        lengths, gap = (left[-1],), capacity - left[-1]
        while True:
            k = bisect.bisect_right(left, gap) - 1
            while k >= 0 and have[left[k]] <= lengths.count(left[k]):
                k -= 1
            if k < 0:
                break
            lengths += (left[k],)
            gap -= left[k]
        out.append((lengths, index.use(lengths)))
        left = [x for x in left if have[x] > 0]
    return out


def slots(kinds: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, in order of rank: the first rank, the first sequence and the offset of every run of pieces."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in kinds:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


#: Least number of groups that a length is dealt over, and pieces of a group, about, beyond that.
SALTS, GROUP_ROWS = 64, 200_000


def ranked(pieces: DataFrame, counts: dict[int, int], id_col: str, salts: int = SALTS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """`pieces` with `rank`, from 0 within each length. A length is dealt over groups, the more the more pieces it has."""
    many = {x: -(-n // group_rows) for x, n in counts.items() if n > salts * group_rows}
    groups = F.lit(salts)
    if many:  # `capacity` lengths at most
        groups = F.coalesce(F.get(F.array(*[F.lit(many.get(x)) for x in range(max(many) + 1)]), F.col("length").cast("int")), groups)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), groups))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("length", "salt").orderBy(F.col(id_col).asc_nulls_first(), "piece", "ids_crc32")
    return salted.withColumn("own", F.row_number().over(own) - 1).join(sizes, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own")).drop("salt", "base", "own")


def packed(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, salts: int = SALTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces of a sequence follow each other from offset 0 without a gap and hold at most `capacity` tokens. Null or empty
    texts are one end id long. Repeated rows and null ids are packed as documents of their own; ties in length go by id. An
    empty table gives no rows. Other columns of `docs` are not read.
    """
    cut = written(token_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    places = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))  # bounded by `capacity`, not by the corpus

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                first, to, at = places.value[x]
                rows = np.flatnonzero(length == x)
                run = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows] = to[run] + rank[rows] - first[run]
                offset[rows] = at[run]
            kept = [batch.column(c) for c in (id_col, "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(docs.dtypes)[id_col]
    return ranked(cut, counts, id_col, salts).mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
