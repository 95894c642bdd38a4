"""Threshold-scaled sketches against whole sets of shingles, and the edited texts against plain Python."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gleaner.llm import sketches
from tests.llm.test_operators import LONG, docs, none, odd  # noqa: F401


def hashes(text, shingle=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return sorted({xxhash.xxh64_intdigest(" ".join(w[k : k + shingle]), 42) for k in range(max(1, len(w) - shingle + 1)) if w})


def sketch(text, scaled=16, least=32):
    own = hashes(text)
    kept = [h for k, h in enumerate(own) if h <= (2**64 - 1) // scaled or k < least]
    return kept, len(kept) == len(own)


def plain(s):
    return s[0].tolist(), s[1]


def one(text, **how):
    return next(sketches.sketches(pa.array([text]), **how))


def contained(a, b):
    """As `containment`, from the sets of two texts."""
    ends = [2**64 if whole else max((2**64 - 1) // 16, own[-1]) for own, whole in (a, b)]
    own = [h for h in a[0] if h <= min(ends)]
    return len(set(own) & set(b[0])) / len(own) if own else float(a == b)


@pytest.mark.parametrize("text", [None, "", " \n", "one", "two words", "A b C d E", LONG, "ÄÖ ß é " * 400, "same same same same same same same"])
def test_sketch_keeps_hashes_below_the_fraction(text):
    assert plain(one(text)) == sketch(text)
    assert sketches.read_form(sketches.written_form(one(text)))[0].tolist() == sketch(text)[0]


def test_merged_sketches_are_those_of_all_shingles_together():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in (3, 20, 60, 900, 4000)]
    for some in (texts, texts[:2], texts[2:3], []):
        whole = sorted({h for t in some for h in hashes(t)})
        kept, complete = plain(sketches.merged([one(t) for t in some]))
        assert kept == whole[: len(kept)] and (not complete or kept == whole)
        assert len(kept) >= min(len(whole), 32) and len(kept) >= sum(h <= (2**64 - 1) // 16 for h in whole)


def test_containment_of_unequal_texts():
    """A page within a book: the estimate is close to 1, and that of the book in the page to the page's share."""
    words = [f"w{x}" for x in np.random.default_rng(3).integers(0, 5000, 40_000)]
    book, page = one(" ".join(words)), one(" ".join(words[5000:9000]))
    assert sketches.containment(page, book) > 0.97
    assert abs(sketches.containment(book, page) - 0.1) < 0.03
    assert sketches.containment(one(""), one(None)) == 1.0
    assert sketches.containment(one(""), page) == sketches.containment(page, one("")) == 0.0
    assert abs(np.mean([sketches.containment(one(" ".join(words[k : k + 300])), one(" ".join(words[k + 150 : k + 450]))) for k in range(0, 30_000, 300)]) - 0.49) < 0.03


def check(rows, got):
    """rows: (id, text) in the order of the operator; got: collected rows."""
    assert len(got) == len(rows)
    want = []
    for k, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = sketch(text), sketch(edited), sketch(following)
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), *(("all:" if s[1] else "part:") + "".join(f"{h:016x}" for h in s[0]) for s in (a, b)), contained(a, b), contained(a, c)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_whole_table(spark, docs):  # noqa: F811
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    check(rows, sketches.compared(docs).collect())
    check(rows, sketches.compared(docs.repartition(7), least=32, scaled=16).collect())


def test_odd_rows(spark, odd):  # noqa: F811
    from pyspark.sql import functions as F

    rows = odd.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    ordered = sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["hash"]))
    check([(r["doc_id"], r["text"]) for r in ordered], sketches.compared(odd).collect())


def test_few_rows(spark, none):  # noqa: F811
    assert not sketches.compared(none).count()
    named = spark.createDataFrame([("b", "first text of two here"), ("a", None)], "name string, body string")
    got = {r["name"]: r for r in sketches.compared(named, id_col="name", text_col="body").collect()}
    assert got["b"]["near_next"] == 0.0 and got["a"]["n_chars"] == 0 and got["a"]["near_edited"] == 1.0
    alone = sketches.compared(spark.createDataFrame([(1, "abcd " * 9)], "doc_id long, text string")).collect()
    check([(1, "abcd " * 9)], alone)


def test_sketches_of_groups(spark):
    rows = [("a", LONG), ("a", "x y z"), ("b", LONG), ("b", " ".join(f"n{k}" for k in range(20_000))), (None, LONG), ("c", None), ("c", "")]
    df = spark.createDataFrame(rows, "source string, text string")
    found = sketches.group_hashes(df, "source")
    want = {(s, h - 2**64 if h >> 63 else h) for s, t in rows for h in hashes(t) if h <= (2**64 - 1) // 16}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    shares = {(r["a"], r["b"]): r["containment"] for r in sketches.group_containment(found, found).collect()}
    assert shares["a", "b"] == shares["a", None] == shares[None, "b"] == 1.0 and 0 < shares["b", "a"] < 1 and ("c", "a") not in shares
