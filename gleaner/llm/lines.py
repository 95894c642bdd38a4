"""Removal of lines that many sites share, in DataFrame functions alone.

A line's spread is its number of distinct sites. It is estimated by HyperLogLog sketches per line hash, merged by
aggregation; lines whose estimate is near the threshold get exact counts; lines at or above it stay only where they first
stand. Texts are split and hashed once into a table of hashes and positions; each text is shuffled once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import written

EDGES = " \t\n\x0b\x0c\r"
#: Parts that a hot line's rows are dealt over before they are summed up.
PARTS = 64


def _line_hash(line: Column) -> Column:
    """Of a line without white space at its ends; null for a line with no word. Equal lines are told by 64 bits of hash."""
    bare = F.trim(line, F.lit(EDGES))
    return F.when(F.length(bare) > 0, F.xxhash64(bare))


def _part(*of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(PARTS)).alias("part")


def spread_lines(lines: DataFrame, min_sites: int, precision: int = 10) -> DataFrame:
    """Hashes of lines on `min_sites` sites or more, from rows (h, site).

    Lines on one site only are left out by the least and greatest site hash. All others are sketched from their rows as they
    are: a task sums up the rows that it has of a line before any is shuffled, and sketches of parts of a line's sites are
    merged, so the shuffle between lets Spark split a hot line's rows in the join before. A sketch of 2^precision registers has
    a relative error of about 1.04 / sqrt(2^precision). Only lines whose estimate is within four errors of the threshold (and
    within 1 at least) are reduced to distinct (line, site) and counted, so the result is that of exact counts but for an
    error of more than four deviations.
    """
    # the number of 0 for a null site, which counts as a site of its own
    sites = lines.select("h", F.xxhash64("site").alias("s"))
    if min_sites <= 1:
        return sites.select("h").distinct()
    several = written(sites.groupBy("h").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a < b").select("h"), "several")
    parts = sites.join(several, "h", "left_semi").groupBy("h", _part("s")).agg(F.hll_sketch_agg("s", precision).alias("sketch"))
    sketched = parts.groupBy("h").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
    sketched = written(sketched, "spread")
    margin = max(1.0, 4 * 1.04 / 2 ** (precision / 2) * min_sites)
    sure = sketched.where(F.col("n") > min_sites + margin).select("h")
    near = sketched.where(F.abs(F.col("n") - min_sites) <= margin).select("h")
    exact = sites.join(near, "h", "left_semi").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h")
    return sure.unionByName(exact)


def deduplicated(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", counts: bool = True) -> DataFrame:
    """`docs` with text_col cleaned and, if `counts`, two columns more: n_lines, n_removed (both long).

    A shared line stays in the document with the smallest id (null first), at its first place there, so that one copy of
    everything remains; lines without a word always stay. Null texts stay null, with 0 lines. Of repeated rows of the same
    id, each keeps the first place. A document of shared lines alone ends as an empty text. An empty table stays empty.
    Columns of `docs` that are called n_lines or n_removed give way to the counts, and stay as they are without them.
    """
    names = docs.columns
    own_names = {n: f"__c{i}" for i, n in enumerate(names)}  # whatever `docs` calls its columns
    docs = docs.toDF(*own_names.values())
    doc, text, site = (F.col(own_names[c]) for c in (id_col, text_col, site_col))
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    split = docs.select(doc.alias("id"), site.alias("site"), key.alias("k"), F.split(text, "\n").alias("lines"))
    each = split.select("id", "site", "k", F.posexplode("lines").alias("p", "line"))
    each = written(each.select("id", "site", "k", "p", _line_hash(F.col("line")).alias("h")).where("h IS NOT NULL"), "lines")

    shared = written(spread_lines(each.select("h", "site"), min_sites), "shared")
    hits = written(each.join(shared, "h", "left_semi").select("h", "id", "k", "p"), "hits")
    at = F.struct(F.col("id").isNotNull().alias("known"), "id", "p")
    first = hits.groupBy("h", _part("id", "p")).agg(F.min(at).alias("first")).groupBy("h").agg(F.min("first").alias("first"))
    first = written(first.select("h", F.col("first.id").alias("first_id"), F.col("first.p").alias("first_p")), "first")
    found = hits.join(first, "h").where(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("p") == F.col("first_p"))))
    gone = written(found.groupBy("id", "k").agg(F.collect_set("p").alias("gone")), "gone")

    joined = docs.withColumn("__k", key).join(gone, (F.col("__k") == F.col("k")) & doc.eqNullSafe(F.col("id")), "left")
    lines = F.split(text, "\n")
    # places that stay, by hash, and the lines there: linear in a text's length
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(stay, lambda i: F.get(ls, i)), "\n"))
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(F.element_at(kept, 1))
    out = [(cleaned if n == text_col else F.col(c)).alias(n) for n, c in own_names.items() if not (counts and n in ("n_lines", "n_removed"))]
    if counts:
        out.append(F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"))
        out.append(F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed"))
    return joined.select(*out)


#: The query's result in DuckDB, by exact counts throughout.
ORACLE = r"""
WITH l AS (SELECT doc_id, source, i - 1 AS p, ls[i] AS line, trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
 FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents))),
s AS (SELECT bare FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT coalesce(source, '')) >= 10),
f AS (SELECT l.*, row_number() OVER (PARTITION BY l.bare ORDER BY doc_id, p) AS k, s.bare IS NOT NULL AS hit FROM l LEFT JOIN s ON l.bare = s.bare),
t AS (SELECT doc_id, count(*)::BIGINT AS n_lines, sum(CASE WHEN hit AND k > 1 THEN 1 ELSE 0 END)::BIGINT AS n_removed,
 coalesce(string_agg(CASE WHEN hit AND k > 1 THEN NULL ELSE line END, chr(10) ORDER BY p), '') AS text FROM f GROUP BY doc_id)
SELECT d.doc_id, t.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN t USING (doc_id)
"""
