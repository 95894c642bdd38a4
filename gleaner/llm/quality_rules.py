"""Host-level quality rules, in DataFrame functions alone.

Each document is measured; failures of each rule are counted by host; a host's rate of each is drawn towards that of all
hosts by a beta prior fitted to the hosts themselves; and the host's verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import written

GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once for a row, as a lambda's argument."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of `window` words that the list has more than once, the first occurrence included.

    Windows are compared by a 64-bit hash of their words' hashes. Texts whose windows all differ stop after one pass;
    others sort their windows, take those equal to a neighbour, and add up what each covers beyond the one before.
    """

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))

    def covered(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)

        def same(e: Column, i: Column) -> Column:
            before = (i > 0) & (F.get(sorted_windows, i - 1)["h"] == e["h"])
            after = (i < n - 1) & (F.get(sorted_windows, i + 1)["h"] == e["h"])
            return before | after

        at = F.array_sort(F.transform(F.filter(sorted_windows, same), lambda e: e["i"]))
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n")), lambda acc: acc["n"])

    def of(h: Column) -> Column:
        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(tagged, covered))

    word_hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(_let(word_hashes, lambda w: _let(hashes(w), of))).cast("long")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_w", _words(text)).withColumn("_l", lines)
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.regexp_replace(text, GAP, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_w")),
        }
    ).drop("_w", "_l")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def broken_rules() -> dict[str, Column]:
    """The four rules and whether a measured document breaks each: base, symbols, short or long words, repeated lines."""
    words = F.col("n_words")
    length = F.when(words > 0, F.col("word_chars") / words)
    return {
        "base": F.col("base_failed"),
        "symbols": F.col("n_symbols") * 10 > words,
        "lengths": ~F.coalesce(length.between(2, 15), F.lit(False)),
        "lines": F.col("n_dup_lines") * 10 > words,
    }


RULES = ("base", "symbols", "lengths", "lines")
#: Strength of a prior where hosts differ no more than chance: as of so many documents.
STRONGEST = 10_000.0


def host_verdicts(rows: DataFrame, host_col: str = "source", deviations: float = 3.0, max_rate: float = 0.5) -> DataFrame:
    """Per host: docs, failed_<rule> and rate_<rule> (shrunk) of each rule, and verdict: ok, watched or rejected.

    A rule's prior is a beta distribution with the mean and variance of the hosts' own rates of breaking it (method of
    moments: the mean by documents, the variance of hosts beyond what draws of so few documents give by chance). A host's
    posterior is that prior with its own counts; its mean is the shrunk rate, and the low end of the rate lies `deviations`
    posterior deviations below. A host whose low end is above the prior's mean for any rule breaks it surely more often than
    hosts do: it is watched. One whose low end is above `max_rate` for any rule as well is rejected. Where hosts differ no
    more than chance, no host is watched. Rows with a null host form a host of their own.
    """
    counts = [F.sum(c.cast("long")).alias(f"failed_{r}") for r, c in broken_rules().items()]
    by_host = written(rows.groupBy(host_col).agg(F.count("*").alias("docs"), *counts), "by-host")
    of_all = [F.avg(1 / F.col("docs")).alias("noise")]
    for r in RULES:
        of_all += [(F.sum(f"failed_{r}") / F.sum("docs")).alias(f"mean_{r}"), F.var_samp(F.col(f"failed_{r}") / F.col("docs")).alias(f"var_{r}")]
    found = by_host.agg(*of_all).first()  # one row
    rates, watched, rejected = [], F.lit(False), F.lit(False)
    for r in RULES:
        mean, strength = _prior(found[f"mean_{r}"], found[f"var_{r}"], found["noise"])
        n = F.col("docs") + F.lit(strength)
        rate = (F.col(f"failed_{r}") + F.lit(mean * strength)) / n
        low = rate - F.lit(float(deviations)) * F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.0)) / (n + 1))
        rates.append(rate.alias(f"rate_{r}"))
        watched = watched | (low > F.lit(mean))
        rejected = rejected | (low > F.lit(float(max_rate)))
    verdict = F.when(rejected, "rejected").when(watched, "watched").otherwise("ok")
    return by_host.select("*", *rates, verdict.alias("verdict"))


def _prior(mean: float | None, var: float | None, noise: float | None) -> tuple[float, float]:
    """Mean and strength of a rule's prior, from the mean and variance of hosts' rates and the mean of 1 / documents."""
    if mean is None:  # no hosts
        return 0.0, STRONGEST
    spread = mean * (1 - mean)
    own = (var or 0.0) - spread * noise
    return mean, min(max(spread / own - 1, 1.0), STRONGEST) if own > 0 else STRONGEST


def verdict_columns() -> tuple[Column, Column]:
    """Whether a joined document (with `verdict`) is kept, and how many of the four rules it breaks."""
    broken = broken_rules()
    n = sum((c.cast("long") for c in list(broken.values())[1:]), broken["base"].cast("long"))
    return ~F.col("base_failed") & ((F.col("verdict") == "ok") | ((F.col("verdict") == "watched") & (n == 0))), n


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", deviations: float = 3.0, max_rate: float = 0.5) -> DataFrame:
    """Per row of `docs`: id_col, host_col, the measures, base_failed, n_broken (of the four rules), host_verdict, host rates, kept.

    A document that fails the base rules is not kept, nor is any of a rejected host, nor one of a watched host that breaks
    any rule. Null and empty texts have no words and fail. Null ids, null hosts and repeated rows are judged like others. An
    empty table gives an empty result. Columns of `docs` besides the three named are not read.
    """
    given = {id_col: "__id", text_col: "__text", host_col: "__host"}
    rows = docs.select(*[F.col(c).alias(n) for c, n in given.items()])
    rows = written(measured(rows, "__text").drop("__text"), "measures")
    verdicts = host_verdicts(rows, "__host", deviations, max_rate)
    verdicts = verdicts.select(F.col("__host").alias("__of"), "verdict", *[f"rate_{r}" for r in RULES])
    joined = rows.join(verdicts, F.col("__host").eqNullSafe(F.col("__of")), "left")
    kept_, broken = verdict_columns()
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rates = [F.col(f"rate_{r}").alias(f"host_rate_{r}") for r in RULES]
    return joined.select(F.col("__id").alias(id_col), F.col("__host").alias(host_col), *measures, broken.alias("n_broken"), F.col("verdict").alias("host_verdict"), *rates, kept_.alias("kept"))


def kept(docs: DataFrame, text_col: str = "text", host_col: str = "source", deviations: float = 3.0, max_rate: float = 0.5) -> DataFrame:
    """Rows of `docs`, all columns, that `judged` keeps, with its cases.

    Null and empty texts go; null hosts are a host of their own; repeated rows are judged alike and all stay or go; an empty
    table stays empty; `docs` may call its columns what it likes. Verdicts, and no texts, are joined to documents.
    """
    names = docs.columns
    own = {n: f"__c{i}" for i, n in enumerate(names)}  # whatever `docs` calls its columns
    rows = written(measured(docs.toDF(*own.values()), own[text_col]), "measured")
    host = own[host_col]
    verdicts = host_verdicts(rows, host, deviations, max_rate).where("verdict <> 'ok'")
    bad = written(verdicts.select(F.col(host).alias("__of"), "verdict"), "hosts")
    left = rows.where(~F.col("base_failed")).join(bad, rows[host].eqNullSafe(bad["__of"]), "left")
    left = left.withColumn("verdict", F.coalesce("verdict", F.lit("ok"))).where(verdict_columns()[0])
    return left.select(*[F.col(c).alias(n) for n, c in own.items()])


#: The same result in DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, hash(ws[i : i + 7]) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
p AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, sum(least(8, i - last)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -7) AS last FROM p) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
 FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
e AS (SELECT *, base_failed AS k_base, n_symbols * 10 > n_words AS k_symbols, n_words = 0 OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS k_lengths, n_dup_lines * 10 > n_words AS k_lines FROM b),
h AS (UNPIVOT (SELECT source, count(*) AS docs, sum(k_base::INT) AS base, sum(k_symbols::INT) AS symbols, sum(k_lengths::INT) AS lengths, sum(k_lines::INT) AS "lines" FROM e GROUP BY source)
 ON base, symbols, lengths, "lines" INTO NAME rule VALUE failed),
q AS (SELECT rule, sum(failed) / sum(docs) AS mean, coalesce(var_samp(failed / docs), 0) AS var, avg(1 / docs) AS noise FROM h GROUP BY rule),
s AS (SELECT rule, mean, CASE WHEN var - mean * (1 - mean) * noise > 0 THEN least(greatest(mean * (1 - mean) / (var - mean * (1 - mean) * noise) - 1, 1.0), 10000.0) ELSE 10000.0 END AS strength FROM q),
v AS (SELECT source, mean, docs + strength AS n, (failed + mean * strength) / (docs + strength) AS rate FROM h JOIN s USING (rule)),
z AS (SELECT source, mean, rate - 3 * sqrt(greatest(rate * (1 - rate), 0.0) / (n + 1)) AS low FROM v),
y AS (SELECT source, CASE WHEN bool_or(low > 0.5) THEN 'rejected' WHEN bool_or(low > mean) THEN 'watched' ELSE 'ok' END AS host_verdict FROM z GROUP BY source)
SELECT e.doc_id, e.source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, k_base::BIGINT + k_symbols::BIGINT + k_lengths::BIGINT + k_lines::BIGINT AS n_broken, host_verdict,
 NOT base_failed AND (host_verdict = 'ok' OR host_verdict = 'watched' AND NOT (k_symbols OR k_lengths OR k_lines)) AS kept
FROM e JOIN y ON e.source IS NOT DISTINCT FROM y.source
"""
