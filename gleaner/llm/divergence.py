"""Audit of how sources of a language differ in the terms that they use.

Terms are packed by length: up to eight bytes are one uint64 word, up to sixteen are two, and equal terms are found by a
radix sort of the words and counted as runs in numpy; longer terms are sorted as bytes, in buckets of equal length. Spark
sums the runs of all tasks. Shares of terms and their differences are integers throughout, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import textscan
from gleaner.llm.shared import written

#: Bytes of text whose terms are counted at a time.
BLOCK_BYTES = 4 << 20
#: Sums of pairs of sources that a task holds before it returns them.
PAIRS = 1 << 20
#: Parts that the sources of a language are dealt over when they meet the others.
PARTS = 64
#: What shares are scaled by, and what is added to every count.
SCALE, PRIOR = 1_000_000_000, 2

_APART = np.ones(256, dtype=bool)
_APART[0x80:] = _APART[0x41:0x5B] = _APART[0x61:0x7B] = False
_MASK = np.array([(1 << 64) - (1 << (64 - 8 * k)) for k in range(9)], np.uint64)

Runs = tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by unsigned words, the first the most significant: a radix pass for each 16 bits that differ."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 8 * word.dtype.itemsize, 16):
            digit = ((word >> word.dtype.type(shift)) & word.dtype.type(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16 bits by radix
    return order


def packed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of at most sixteen bytes as two words whose order is that of the bytes; `data` has sixteen spare bytes at its end."""
    lanes = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    first = lanes[starts].astype(np.uint64) & _MASK[np.minimum(sizes, 8)]
    return first, lanes[starts + 8].astype(np.uint64) & _MASK[np.maximum(sizes - 8, 0)]


def _texts(first: np.ndarray, second: np.ndarray | None) -> pa.Array:
    """Packed terms as strings: no term has a byte of zero."""
    rows = np.stack([first] if second is None else [first, second], axis=1).astype(">u8").view(np.uint8)
    there = rows != 0
    return _strings(rows[there], there.sum(axis=1))


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _counted(edges: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and different documents of each run; documents ascend in a run."""
    if not len(edges):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.ones(len(doc), np.int64)
    new[1:] = doc[1:] != doc[:-1]
    new[edges] = 1
    return np.diff(np.append(edges, len(doc))), np.add.reduceat(new, edges)


def runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, doc: np.ndarray, group: np.ndarray) -> Iterator[Runs]:
    """(group, term, occurrences, documents) of each term in each group, by buckets; `doc` ascends and `group` is a document's."""
    for low, high in ((0, 8), (8, 16)):
        own = np.flatnonzero((sizes > low) & (sizes <= high))
        if len(own):
            first, second = packed(data, starts[own], sizes[own])
            keys = [group[own], first] + ([second] if low else [])
            order = radix_order(keys)
            keys = [k[order] for k in keys]
            edges = _edges(*keys)
            yield (keys[0][edges], _texts(keys[1][edges], keys[2][edges] if low else None), *_counted(edges, doc[own[order]]))
    long = np.flatnonzero(sizes > 16)
    for size in np.unique(sizes[long]).tolist():
        own = long[sizes[long] == size]
        terms = data[starts[own][:, None] + np.arange(size)].view(f"S{size}")[:, 0]
        order = np.argsort(terms, kind="stable")
        order = order[radix_order([group[own[order]]])]
        terms, groups = terms[order], group[own[order]]
        edges = _edges(groups, terms)
        yield (groups[edges], _strings(terms[edges].view(np.uint8), np.full(len(edges), size)), *_counted(edges, doc[own[order]]))


def _pieces(own: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK_BYTES of a long text, which end where no term goes on."""
    low = 0
    while low < len(own):
        high = min(low + BLOCK_BYTES, len(own))
        while high < len(own) and not _APART[own[high]]:
            step = own[high : high + 4096]
            apart = np.flatnonzero(_APART[step])
            high += int(apart[0]) if len(apart) else len(step)
        yield low, high
        low = high


def _scanned(own: np.ndarray, at: np.ndarray, group: np.ndarray) -> Iterator[Runs]:
    starts, ends, docs = textscan.words(own, at, _APART)
    doc = np.repeat(np.arange(len(docs) - 1), np.diff(docs))
    yield from runs(np.concatenate([textscan.lower(own), np.zeros(16, np.uint8)]), starts, ends - starts, doc, group[doc])


def _block(own: np.ndarray, at: np.ndarray, group: np.ndarray) -> Iterator[Runs]:
    """Runs of a block's documents. A text longer than a block goes piece by piece, and counts as one document for each term."""
    if len(group) > 1 or len(own) <= BLOCK_BYTES:
        yield from _scanned(own, at, group)
        return
    terms, counts = [], []
    for low, high in _pieces(own):
        for _, term, n, _ in _scanned(own[low:high], np.array([0, high - low]), group):
            terms.append(term)
            counts.append(pa.array(n))
    if terms:
        sums = pa.table([pa.concat_arrays(terms), pa.concat_arrays(counts)], ["t", "n"]).group_by("t").aggregate([("n", "sum")]).combine_chunks()
        yield np.repeat(group, len(sums)), sums["t"].combine_chunks(), sums["n_sum"].to_numpy(), np.ones(len(sums), np.int64)


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): how often, and in how many documents, a term stands in a source's texts of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple[str, str], int] = {}
            group = np.array([known.setdefault(k, len(known)) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.uint32)
            names = [pa.array([k[c] for k in known], pa.string()) for c in (0, 1)]
            data, offsets = textscan.utf8(batch.column(2))
            for i, j in textscan.blocks(offsets, BLOCK_BYTES):
                for g, term, n, docs_ in _block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], group[i:j]):
                    at = pa.array(g)
                    yield pa.record_batch([names[0].take(at), names[1].take(at), term, pa.array(n), pa.array(docs_)], ["lang", "source", "term", "n", "docs"])

    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    found = given.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kinds)), exact."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + F.lit(PRIOR)).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, (total + F.lit(PRIOR) * kinds).cast("decimal(19,0)"))


def _far(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _met(rows: DataFrame) -> DataFrame:
    """(lang, a, b, more) for sources a < b: what terms of both add to the sums that take each term to be of one alone.

    `rows` has (lang, source, term, p, zero). Tasks have all of a term's rows, one for each source, and return sums, not pairs.
    """

    def sums(held: dict[tuple[str, str, str], int]) -> pa.RecordBatch:
        keys = list(zip(*held, strict=True)) or [(), (), ()]
        return pa.record_batch([*(pa.array(k, pa.string()) for k in keys), pa.array(list(held.values()), pa.int64())], ["lang", "a", "b", "more"])

    def add(table: pa.Table, held: dict[tuple[str, str, str], int]) -> None:
        lang, source, term = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source", "term"))
        term_no, lang_no, source_no = (c.indices.to_numpy().astype(np.int64) for c in (term, lang, source))
        p, zero = table["p"].to_numpy(), table["zero"].to_numpy()
        far = lambda x, y: (x - y) * (x - y) // (x + y)
        left, shift, many = np.arange(len(p)), 1, len(source.dictionary)
        names, langs = source.dictionary.to_pylist(), lang.dictionary.to_pylist()
        while len(left):
            left = left[left + shift < len(p)]
            left = left[(term_no[left + shift] == term_no[left]) & (lang_no[left + shift] == lang_no[left])]
            right = left + shift
            more = far(p[left], p[right]) - far(p[left], zero[right]) - far(zero[left], p[right]) + far(zero[left], zero[right])
            pair, of = np.unique((lang_no[left] * many + source_no[left]) * many + source_no[right], return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, of, more)
            for k, n in zip(pair.tolist(), total.tolist(), strict=True):
                key = (langs[k // (many * many)], names[k // many % many], names[k % many])
                held[key] = held.get(key, 0) + n
            shift += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, str], int] = {}
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            last = table.num_rows - 1  # the last term may go on in the next batch
            of = [table["lang"][last], table["term"][last]]
            while last and table["term"][last - 1] == of[1] and table["lang"][last - 1] == of[0]:
                last -= 1
            add(table.slice(0, last), held)
            rest = table.slice(last)
            if len(held) > PAIRS:
                yield sums(held)
                held = {}
        if rest is not None:
            add(rest, held)
        yield sums(held)

    dealt = rows.select("lang", "source", "term", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(run, "lang string, a string, b string, more long").groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))


def audited(docs: DataFrame, min_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) of each source of each language.

    Part `pair`: every other source of the language by the sum, over the language's terms (those in `min_docs` of its
    documents or more), of (p - q)^2 / (p + q) of the smoothed shares in both; farthest first. Part `term`: the `top` terms
    whose share in the source exceeds that in the language most, by the same measure. Ties go by item.

    Null text, lang and source are empty strings; an empty source or language is one of its own. Repeated rows are documents
    each. A source without terms has the smoothed share of none; a language without terms has pairs of value 0. An empty
    table gives no rows. Other columns are not read, whatever their names.

    The sum over pairs of sources is taken from each source's own terms against the other's share of a term it lacks, which
    needs only how often each share occurs, and from what terms that both have add to that; so no task meets all terms, and
    terms that neither has are not formed.
    """
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))])
    counts = written(term_counts(docs, lang_col, source_col, text_col), "counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= min_docs).select("lang", "term", "total")
    rows = written(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "kept")
    langs = rows.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("total").alias("all"))
    own = rows.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("own"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = given.distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *[zero(c) for c in ("size", "own", "kinds", "all")])
    groups = groups.withColumn("zero", F.when(F.col("kinds") > 0, _share(F.lit(0).cast("long"), F.col("size"), F.col("kinds"))))
    groups = written(groups, "groups")

    shares = rows.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "zero", _share(F.col("n"), F.col("size"), F.col("kinds")).alias("p"), _share(F.col("total"), F.col("all"), F.col("kinds")).alias("q")
    )
    shares = written(shares, "shares")
    over = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _far(F.col("p"), F.col("q")).alias("value"))

    often = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "k")).alias("often"))
    left = groups.join(often, ["lang", "source"], "left").select("lang", F.col("source").alias("a"), "kinds", F.col("own").alias("own_a"), F.col("zero").alias("zero_a"), F.coalesce("often", F.array().cast("array<struct<p:bigint,k:bigint>>")).alias("often"))
    left = left.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(PARTS)))
    right = groups.select("lang", F.col("source").alias("b"), F.col("own").alias("own_b"), F.col("zero").alias("zero_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
    pairs = left.join(right, ["lang", "part"]).where("a <> b")
    alone = F.aggregate("often", F.lit(0).cast("long"), lambda s, x: s + x["k"] * _far(x["p"], F.col("zero_b")))
    pairs = pairs.select("lang", "a", "b", alone.alias("alone"), ((F.col("kinds") - F.col("own_a") - F.col("own_b")) * _far(F.col("zero_a"), F.col("zero_b"))).alias("none"))
    # what a's own terms add, what b's own terms add, what neither's and what both's
    pairs = written(pairs, "pairs")
    other = pairs.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("alone").alias("alone_b"))
    met = _met(shares)
    both = met.unionByName(met.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "more"))
    value = F.coalesce(F.col("alone") + F.col("alone_b") + F.col("none"), F.lit(0).cast("long")) + F.coalesce("more", F.lit(0).cast("long"))
    pairs = pairs.join(other, ["lang", "a", "b"]).join(both, ["lang", "a", "b"], "left").select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)


#: The query's result in DuckDB, with every term of every pair of sources.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
g AS (SELECT d.lang, d.source, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = d.lang AND c.source = d.source)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) AS d),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.n + 2 * l.v) AS p, 1 + 1000000000::HUGEINT * (k.total + 2) // (l.n + 2 * l.v) AS q
 FROM g JOIN l ON g.lang = l.lang JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
WHERE part = 'pair' OR rank <= 10
"""
