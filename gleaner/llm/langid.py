"""Language of texts by a linear-chain conditional random field over their words.

Each word is labelled with a language, by features of its affixes, letter n-grams and itself (a lexicon of training words),
and by learned transitions between the labels of neighbours, so that text which changes language midway is followed.
Forward-backward gives each word's distribution; a text's language is the one with the most expected words.
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
from gleaner.llm.tokens import _classes

BUCKETS = 1 << 17
NGRAM = 4
SEGMENT = 64
BLOCK_BYTES = 2 << 20


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets of words, the word of each, and whether a word has a letter.

    Features are n-grams of one to four letters of the lower-cased word between spaces (so those with a space are its
    affixes), and the word as a whole.
    """
    lowered = [w.lower() for w in words]
    points = np.frombuffer((" " + "  ".join(lowered) + " ").encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    edge = np.concatenate([[0], np.cumsum(size)])
    with np.errstate(over="ignore"):
        mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        buckets, owners = [], []
        gram = np.zeros(len(points), np.uint64)
        for n in range(NGRAM):
            gram = gram[: len(points) - n] * np.uint64(0xBF58476D1CE4E5B9) + mixed[n:] if n else mixed.copy()
            inside = owner[: len(points) - n] == owner[n:]
            if n == 0:
                inside &= points != 0x20
            buckets.append(((gram[inside] ^ (gram[inside] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB + 2 * n)) >> np.uint64(64 - 17))
            owners.append(owner[: len(points) - n][inside])
        place = np.arange(len(points)) - np.repeat(edge[:-1], size)
        whole = np.add.reduceat(mixed * (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)), edge[:-1]) if len(words) else np.empty(0, np.uint64)
        buckets.append((whole * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - 17))
        owners.append(np.arange(len(words)))
    letter = np.zeros(len(words), bool)
    letter[owner[_classes()[points] == 1]] = True
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), letter


@dataclass
class Field:
    """Languages, weights by bucket and language, and transition weights."""

    langs: list[str]
    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        bucket, owner, letter = word_features(words)
        out = _emit(self.weights, bucket, owner, len(words))
        out[~letter] = 0
        return out, letter


def _emit(weights: np.ndarray, bucket: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    total = np.bincount(owner, minlength=n)
    sums = np.stack([np.bincount(owner, weights[bucket, k], minlength=n) for k in range(weights.shape[1])], axis=1)
    return sums / np.sqrt(np.maximum(total, 1))[:, None]


def marginals(emission: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label distributions of sequences of equal length (sequences, words, labels), and expected moves between labels, by forward-backward."""
    n, t, k = emission.shape
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    a = np.exp(moves - moves.max())
    forward, backward = np.empty_like(e), np.ones((n, t, k))
    state = np.full((n, k), 1 / k)
    for i in range(t):
        state = (state @ a if i else state) * e[:, i]
        state /= state.sum(axis=1, keepdims=True)
        forward[:, i] = state
    back = np.ones((n, k))
    for i in range(t - 2, -1, -1):
        back = (e[:, i + 1] * back) @ a.T
        back /= back.sum(axis=1, keepdims=True)
        backward[:, i] = back
    post = forward * backward
    joint = forward[:, :-1, :, None] * a * (e * backward)[:, 1:, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    return post / post.sum(axis=2, keepdims=True), joint.sum(axis=(0, 1))


def fitted(spans: list[tuple[list[str], int]], langs: list[str], rounds: int = 30, length: int = 48, seed: int = 3) -> Field:
    """A field from labelled runs of words. Training sequences put runs of up to three languages on end, to learn changes."""
    k = len(langs)
    field = Field(langs, np.zeros((BUCKETS, max(k, 1))), np.zeros((max(k, 1), max(k, 1))))
    spans = [(w, y) for w, y in spans if w]
    if k < 2 or not spans:
        return field
    draw = np.random.default_rng(seed)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in spans for w in words))}
    coded = [np.array([vocabulary[w] for w in words]) for words, _ in spans]
    rows, labels = [], []
    for words, (_, y) in zip(coded, spans, strict=True):
        row, label = [words[:length]], [np.full(len(words[:length]), y)]
        while sum(map(len, row)) < length or draw.random() < 0.3:
            other = int(draw.integers(len(spans)))
            take = coded[other][: int(draw.integers(4, 25))]
            row.append(take)
            label.append(np.full(len(take), spans[other][1]))
        start = int(draw.integers(0, sum(map(len, row)) - length + 1))
        rows.append(np.concatenate(row)[start : start + length])
        labels.append(np.concatenate(label)[start : start + length])
    x, y = np.stack(rows), np.stack(labels)
    bucket, owner, letter = word_features(list(vocabulary))
    share = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(vocabulary)), 1))
    truth = np.eye(k)[y]
    seen, moves_seen = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)
    follows = np.einsum("ntj,ntk->jk", truth[:, :-1], truth[:, 1:])
    for _ in range(rounds):
        emission = _emit(field.weights, bucket, owner, len(vocabulary))
        emission[~letter] = 0
        own = emission[x]
        post, moved = marginals(own, field.moves)
        lack = (truth - post) * letter[x][..., None]
        by_word = np.stack([np.bincount(x.reshape(-1), lack[..., j].reshape(-1), minlength=len(vocabulary)) for j in range(k)], axis=1) * share[:, None]
        gradient = np.stack([np.bincount(bucket, by_word[owner, j], minlength=BUCKETS) for j in range(k)], axis=1) - 1e-3 * field.weights
        seen += gradient**2
        field.weights += 0.5 * gradient / np.sqrt(seen)
        move = (follows - moved) / len(x) - 1e-3 * field.moves
        moves_seen += move**2
        field.moves += 0.3 * move / np.sqrt(moves_seen)
    return field


def expected_words(emission: np.ndarray, letter: np.ndarray, docs: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Expected number of words with a letter in each language, for each document of a block.

    `emission` has a row per word of all documents on end, `docs` the range of words of each. Documents are split into
    segments that run side by side; a first pass finds each segment's whole transfer matrix, these are chained along a
    document, and a second pass runs forward-backward from the states that the chain gives. The result is that of a pass
    over the whole document.
    """
    k = emission.shape[1]
    n = np.diff(docs)
    parts = -(-n // SEGMENT)
    total = int(parts.sum())
    out = np.zeros((len(n), k))
    if not total:
        return out
    first = np.concatenate([[0], np.cumsum(parts)])
    of = np.repeat(np.arange(len(n)), parts)
    nth = np.arange(total) - first[of]
    start = docs[of] + nth * SEGMENT
    size = np.minimum(SEGMENT, docs[of + 1] - start)
    order = np.argsort(-size, kind="stable")  # long ones first, so that those still running are a prefix
    start_, size_ = start[order], size[order]
    running = np.searchsorted(-size_, -np.arange(SEGMENT), "left")
    e = np.exp(emission - emission.max(axis=1, keepdims=True)).astype(np.float32)
    a = np.exp(moves - moves.max()).astype(np.float32)
    opens = (nth == 0)[order]  # a document's first word follows none
    whole = np.tile(np.eye(k, dtype=np.float32), (total, 1, 1))
    for t in range(SEGMENT):
        r = int(running[t])
        if not r:
            break
        m = (whole[:r].reshape(-1, k) @ a).reshape(r, k, k)
        if not t:
            m[opens[:r]] = whole[:r][opens[:r]]
        m *= e[start_[:r] + t][:, None, :]
        whole[:r] = m / m.max(axis=(1, 2), keepdims=True)
    unsorted = np.empty_like(whole)
    unsorted[order] = whole
    into, after = np.full((total, k), 1 / k, np.float32), np.ones((total, k), np.float32)
    most = int(parts.max())
    for i in range(1, most):
        seg = first[:-1][parts > i] + i
        state = np.einsum("sj,sjk->sk", into[seg - 1], unsorted[seg - 1])
        into[seg] = state / state.sum(axis=1, keepdims=True)
    for i in range(most - 1, 0, -1):
        seg = first[:-1][parts > i] + i
        state = np.einsum("sjk,sk->sj", unsorted[seg], after[seg])
        after[seg - 1] = state / state.sum(axis=1, keepdims=True)
    state, back = into[order], after[order]
    forward = np.empty((SEGMENT, total, k), np.float32)
    for t in range(SEGMENT):
        r = int(running[t])
        if not r:
            break
        step = state[:r] @ a
        if not t:
            step[opens[:r]] = state[:r][opens[:r]]
        step *= e[start_[:r] + t]
        state[:r] = step / step.sum(axis=1, keepdims=True)
        forward[t, :r] = state[:r]
    sums = np.zeros((total, k))
    for t in range(SEGMENT - 1, -1, -1):
        r = int(running[t])
        if not r:
            continue
        post = forward[t, :r] * back[:r]
        post /= post.sum(axis=1, keepdims=True)
        at = start_[:r] + t
        sums[:r] += post * letter[at][:, None]
        step = (e[at] * back[:r]) @ a.T
        back[:r] = step / step.sum(axis=1, keepdims=True)
    by_segment = np.empty_like(sums)
    by_segment[order] = sums
    some = np.flatnonzero(parts)
    out[some] = np.add.reduceat(by_segment, first[some], axis=0)
    return out


def trained(docs: DataFrame, quota: int = 500, held_out: tuple[int, int] = (5, 0), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", run_words: int = 48, runs: int = 2) -> Field:
    """A field from about `quota` documents of each language at most, none of the held-out fold.

    The field is fitted to a sample: of each sampled document, `runs` runs of `run_words` words, from places anywhere in the
    text that a hash picks, reach the driver, so what it holds is bounded by these, the quota and the number of languages. Of rows that repeat an id and language, one counts. Null languages,
    ids and texts are left out.
    """
    modulus, remainder = held_out
    given = docs.select(F.col(id_col).alias("_of"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_in"))
    own = given.where(F.col("_of").isNotNull() & F.col("_in").isNotNull() & (fold("_of", modulus) != remainder))
    ids = class_sample(own.select("_of", "_in"), "_of", "_in", quota).select(F.col("_of").alias("_id"), F.col("_in").alias("_lang")).distinct()
    ids = written(ids, "languages")  # the quota for each language
    chosen = own.join(F.broadcast(ids), (F.col("_of") == F.col("_id")) & (F.col("_in") == F.col("_lang")))
    words = chosen.select("_id", "_lang", F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), "").alias("w")).where(F.size("w") > 0)
    places = [F.slice("w", F.pmod(F.xxhash64("_id", F.lit(s)), F.greatest(F.size("w") - run_words + 1, F.lit(1))).cast("int") + 1, run_words).alias(f"w{s}") for s in range(1, runs + 1)]
    taken = words.select("_id", "_lang", F.struct(*places).alias("runs")).groupBy("_id", "_lang").agg(F.min("runs").alias("runs"))
    rows = sorted((r["_lang"], *r["runs"]) for r in taken.collect())
    langs = sorted({r[0] for r in rows})
    at = {x: i for i, x in enumerate(langs)}
    return fitted([(list(w), at[y]) for y, *both in rows for w in both], langs)


def predicted(docs: DataFrame, field: Field, held_out: tuple[int, int] = (5, 0), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, held_out, lang_pred, score (the share of words expected in that language).

    Null texts, and texts without a letter, are `und` with score 0. Ties go to the first language by name. A null id is not
    held out. Repeated rows are predicted alike; an empty table gives an empty result; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Field(field.langs, field.weights.astype(np.float32), field.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            data, offsets = textscan.utf8(batch.column(1))
            for i, j in textscan.blocks(offsets, BLOCK_BYTES):
                raw, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, ranges = textscan.words(raw, at)
                if len(starts):
                    text, begin = textscan.joined(raw, starts, ends)
                    edge = np.append(begin, begin[-1] + ends[-1] - starts[-1] + 1).astype(np.int32)
                    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edge.tobytes()), pa.py_buffer(text.tobytes())).dictionary_encode()
                    emission, letter = own.emissions([w[:-1] for w in coded.dictionary.to_pylist()])
                    codes = coded.indices.to_numpy()
                    share = expected_words(emission[codes], letter[codes], ranges, own.moves)
                else:
                    share = np.zeros((j - i, max(len(own.langs), 1)))
                total = share.sum(axis=1)
                best = share.argmax(axis=1)
                known = (total > 0) & (len(own.langs) > 0)
                langs = [own.langs[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
                score = np.where(known, share.max(axis=1) / np.maximum(total, 1e-12), 0.0)
                yield pa.record_batch([batch.column(0)[i:j], pa.array(langs, pa.string()), pa.array(np.clip(score, 0, 1))], ["id", "lang_pred", "score"])

    modulus, remainder = held_out
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
    return out.select(id_col, F.coalesce(fold(id_col, modulus) == remainder, F.lit(False)).alias("held_out"), "lang_pred", "score")
