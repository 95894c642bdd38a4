"""Document quality by Bradley-Terry ranking.

Pairs of a better and a worse labelled document are compared: the chance that the better wins is the logistic function of
the difference of their scores, a score being linear in a document's features, so the weights come from logistic loss on
feature differences. Features are measures of the text's surface, each once more as a yes or no at a cut that is learned,
and the shares of its words in hashed buckets. A quantile of the learned scores is the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import textscan
from gleaner.llm.shared import class_sample, fold, written

BLOCK_BYTES = 1 << 20
MEASURES = ("log_words", "word_bytes", "next_repeats", "repeats", "marks", "bars", "shouts", "capitals", "digits", "stops", "lines", "letters_alone")
#: Buckets of words.
BUCKETS = 512


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_MARKS, _UPPER, _LOWERCASE, _DIGITS = _table("#*$%&<>@^~"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz"), _table("0123456789")
_BARS, _SHOUTS, _STOPS, _BREAKS = _table("|"), _table("!?"), _table(".,;:"), _table("\n")


def _per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows: MEASURES of whole texts (a row each), the bucket of every word, and the range of words of each text.

    A text without a word has measures of zero.
    """
    data, offsets = textscan.utf8(column)
    for i, j in textscan.blocks(offsets, BLOCK_BYTES):
        own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, docs = textscan.words(own, at)
        n = np.diff(docs)
        some = np.maximum(n, 1)
        text, begin = textscan.joined(own, starts, ends)
        hashes = textscan.xxh64(text, begin, ends - starts, 7) if len(starts) else np.empty(0, np.uint64)
        doc = np.repeat(np.arange(j - i), n)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        order = np.lexsort((hashes, doc))
        h, d = hashes[order], doc[order]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        count = lambda table: _per_doc(table[own], at)  # noqa: B023, E731
        upper, small = count(_UPPER), count(_LOWERCASE)
        size = _per_doc(ends - starts, docs) if len(starts) else np.zeros(j - i)
        alone = _per_doc((ends - starts) == 1, docs) if len(starts) else np.zeros(j - i)
        columns = [
            np.log1p(n),
            size / some,
            _per_doc(same, docs) / some,
            _per_doc(again, docs) / some,
            count(_MARKS) / some,
            count(_BARS) / some,
            count(_SHOUTS) / some,
            upper / np.maximum(upper + small, 1),
            count(_DIGITS) / some,
            count(_STOPS) / some,
            count(_BREAKS) / some,
            alone / some,
        ]
        yield i, j, np.stack([np.asarray(c, np.float64) for c in columns], axis=1) * (n > 0)[:, None], (hashes % np.uint64(BUCKETS)).astype(np.int64), docs


def shares(bucket: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each text, the share of its words in each bucket."""
    n = np.diff(docs)
    counts = np.bincount(np.repeat(np.arange(len(n)), n) * BUCKETS + bucket, minlength=len(n) * BUCKETS).reshape(len(n), BUCKETS)
    return counts / np.maximum(n, 1)[:, None]


@dataclass
class Ranker:
    """A learned score: standardised measures and cuts by weights, plus the mean weight of words, less the threshold, through the logistic function."""

    cuts: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    words: np.ndarray
    threshold: float

    def dense(self, x: np.ndarray) -> np.ndarray:
        return np.clip((np.concatenate([x, x > self.cuts], axis=1) - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray, bucket: np.ndarray, docs: np.ndarray) -> np.ndarray:
        raw = self.dense(x) @ self.weights + _per_doc(self.words[bucket], docs) / np.maximum(np.diff(docs), 1)
        return 1 / (1 + np.exp(-np.clip(raw - self.threshold, -30, 30)))


def learned_cut(better: np.ndarray, worse: np.ndarray) -> float:
    """Where one measure parts two samples best, of the quantiles of both."""
    tries = np.unique(np.quantile(np.concatenate([better, worse]), np.linspace(0, 1, 101)))
    above = lambda v: 1 - np.searchsorted(np.sort(v), tries, "right") / len(v)
    return float(tries[np.argmax(np.abs(above(better) - above(worse)))])


def pair_gradient(w: np.ndarray, difference: np.ndarray, decay: np.ndarray) -> np.ndarray:
    """Descent direction of the mean logistic loss of pairs (better less worse), log(1 + exp(-difference w)), and decay / 2 of squared weights."""
    lost = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
    return lost @ difference / len(difference) - decay * w


def learned(x: np.ndarray, h: np.ndarray, y: np.ndarray, pairs: int = 2_000, rounds: int = 600, seed: int = 5) -> Ranker:
    """Weights by gradient steps, each on newly drawn pairs of rows with y = 1 and y = 0, from measures x and shares h.

    The threshold is the quantile of all scores that parts labels best. With labels of one kind, or none, there are no
    pairs: weights are zero and every score is a half.
    """
    k = len(MEASURES)
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(better) or not len(worse):
        return Ranker(np.zeros(k), np.zeros(2 * k), np.ones(2 * k), np.zeros(2 * k), np.zeros(BUCKETS), 0.0)
    cuts = np.array([learned_cut(x[better, c], x[worse, c]) for c in range(k)])
    both = np.concatenate([x, x > cuts], axis=1)
    # both kinds weigh alike in centre and scale
    mean = (both[better].mean(axis=0) + both[worse].mean(axis=0)) / 2
    scale = np.sqrt((both[better].var(axis=0) + both[worse].var(axis=0)) / 2 + (both[better].mean(axis=0) - both[worse].mean(axis=0)) ** 2 / 4)
    ranker = Ranker(cuts, mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(2 * k), np.zeros(BUCKETS), 0.0)
    unit = max(float(h.std()), 1e-9) * 3  # shares are left as they are but for one unit, so that a score needs sums of words alone
    z = np.concatenate([ranker.dense(x), h / unit], axis=1).astype(np.float32)
    decay = np.concatenate([np.full(2 * k, 1e-3), np.full(BUCKETS, 1e-2)])
    draw = np.random.default_rng(seed)
    w, speed, mean_w = (np.zeros(z.shape[1]) for _ in range(3))
    for step in range(rounds):
        difference = z[draw.choice(better, pairs)] - z[draw.choice(worse, pairs)]
        speed = 0.9 * speed + pair_gradient(w, difference, decay)
        w = w + 0.2 * speed
        if 2 * step >= rounds:  # the mean of the later half
            mean_w += w / (rounds - (rounds + 1) // 2)
    scores = z @ mean_w
    tries = np.unique(np.quantile(scores, np.linspace(0, 1, 401)))
    up, down = np.sort(scores[better]), np.sort(scores[worse])
    right = (1 - np.searchsorted(up, tries, "left") / len(up)) + np.searchsorted(down, tries, "left") / len(down)
    best = tries[int(np.argmax(right))]
    low = scores[scores < best]
    ranker.weights, ranker.words = mean_w[: 2 * k], mean_w[2 * k :] / unit
    ranker.threshold = float((best + low.max()) / 2) if len(low) else float(best)
    return ranker


def measured(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """`columns` of docs, the measures `x` and the shares `h` of words, both as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x, bucket, docs_ in features(batch.column(len(columns))):
                for a in range(0, j - i, 1024):
                    b = min(a + 1024, j - i)
                    h = shares(bucket[docs_[a] : docs_[b]], docs_[a : b + 1] - docs_[a]).astype(np.float32)
                    raw = [pa.array([r.tobytes() for r in part], pa.binary()) for part in (x[a:b], h)]
                    yield pa.record_batch([*[batch.column(k)[i + a : i + b] for k in range(len(columns))], *raw], [*columns, "x", "h"])

    kinds = dict(docs.dtypes)
    return docs.select(*columns, F.col(text_col).alias("_text")).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], "x binary", "h binary"]))


def trained(docs: DataFrame, labels: DataFrame, quota: int = 5_000, held_out: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker:
    """A ranker from at most about `quota` labelled documents of each label, none of the held-out fold.

    The sample is chosen by a hash of the id; only its features reach the driver, one row for each id (of rows that repeat
    an id, that whose text has the least hash). Ids with both labels, or null, are left out.
    """
    modulus, remainder = held_out
    clean = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(id_col, modulus) != remainder))
    clean = clean.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z")).where("_y = _z").select("_id", "_y")
    sample = written(class_sample(clean, "_id", "_y", quota), "labelled")  # two labels times the quota
    given = docs.select(F.col(id_col).alias("_of"), F.col(text_col).alias("_text"))
    chosen = given.join(F.broadcast(sample), F.col("_of") == F.col("_id"))
    chosen = chosen.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("least")).select("_y", F.col("least._text").alias("_text"))
    rows = measured(chosen, ["_y"], "_text").collect()
    rows.sort(key=lambda r: (r["_y"], r["x"], r["h"]))  # whatever the order of tasks
    x = np.array([np.frombuffer(r["x"], np.float64) for r in rows]).reshape(len(rows), len(MEASURES))
    h = np.array([np.frombuffer(r["h"], np.float32) for r in rows], np.float32).reshape(len(rows), BUCKETS)
    return learned(x, h, np.array([r["_y"] for r in rows]))


def scored(docs: DataFrame, ranker: Ranker, held_out: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Empty and null texts score as a text without words. A null id is not held out. Repeated rows score alike, and other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, *own in features(batch.column(1)):
                yield pa.record_batch([batch.column(0)[i:j], pa.array(ranker.score(*own))], ["id", "score"])

    modulus, remainder = held_out
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
    return out.select(id_col, F.coalesce(fold(id_col, modulus) == remainder, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, ranker: Ranker, text_col: str = "text") -> DataFrame:
    """Rows of `docs`, all columns, that score a half or more.

    Null and empty texts score as a text without words, and rows without an id like others. Repeated rows all stay or go; an
    empty table stays empty; `docs` may call its columns what it likes.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in batches:
            for i, j, *own in features(batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(ranker.score(*own) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
