"""Source divergence audit: packing, radix order and runs against plain Python, and the audit against a brute-force version."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import divergence, textscan
from tests.llm.test_operators import LONG, SCHEMA, none, odd  # noqa: F401


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def audit(rows, min_docs, top):
    """(lang, source, part, item, value, rank) from (lang, source, text), by all terms of all pairs."""
    rows = [(a or "", b or "", terms(t)) for a, b, t in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        seen = Counter(t for r in own for t in set(r[2]))
        kept = {t for t, n in seen.items() if n >= min_docs}
        counts = defaultdict(Counter)
        for _, source, ts in own:
            counts[source].update(t for t in ts if t in kept)
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        whole = sum(counts.values(), Counter())
        far = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in counts.items():
            pairs = [(-sum(far(share(c, t), share(d, t)) for t in kept), o.encode(), o) for o, d in counts.items() if o != s]
            over = [(-far(share(c, t), share(whole, t)), t.encode(), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", sorted(over)[:top])):
                out |= {(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(sorted(found), 1)}
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_radix_order_is_the_stable_order():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 3, 5000).astype(np.uint32), rng.integers(0, 1 << 63, 5000).astype(np.uint64) >> np.uint64(40), rng.integers(0, 5, 5000).astype(np.uint64)]
    assert (divergence.radix_order(words) == np.lexsort(words[::-1])).all()
    assert len(divergence.radix_order([np.empty(0, np.uint64)])) == 0


def test_packed_words_are_in_the_order_of_bytes():
    some = ["a", "ab", "b", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "é", "éa", "zz", "日本語", "abcdefgz"]
    data = np.frombuffer("".join(some).encode() + bytes(16), np.uint8)
    sizes = np.array([len(s.encode()) for s in some])
    first, second = divergence.packed(data, np.cumsum(sizes) - sizes, sizes)
    order = divergence.radix_order([first, second])
    assert [some[k] for k in order] == sorted(some, key=str.encode)
    assert divergence._texts(first, second).to_pylist() == some


@pytest.mark.parametrize("size", [1 << 22, 64, 3])
def test_runs_of_blocks_and_of_long_texts(monkeypatch, size):
    """Every bucket, and texts of several pieces, which count as one document for each term."""
    monkeypatch.setattr(divergence, "BLOCK_BYTES", size)
    texts = ["One one two", "", "donaudampfschifffahrtsgesellschaft " * 3 + "Äpfel äpfel two", "x" * 200 + " one", "chars-of_a{b}", "中文文本没有空格" * 9 + " 中文"]
    groups = np.array([0, 1, 1, 0, 2, 2], np.uint32)
    data, offsets = textscan.utf8(pa.array(texts))
    n, docs = Counter(), Counter()
    for i, j in textscan.blocks(offsets, size):
        for g, term, count, seen in divergence._block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], groups[i:j]):
            for a, t, c, d in zip(g.tolist(), term.to_pylist(), count.tolist(), seen.tolist(), strict=True):
                n[a, t] += c
                docs[a, t] += d
    want_n, want_docs = Counter(), Counter()
    for g, t in zip(groups.tolist(), texts, strict=True):
        want_n.update((g, x) for x in terms(t))
        want_docs.update((g, x) for x in set(terms(t)))
    assert n == want_n and docs == want_docs


def test_audit_of_odd_rows(spark, odd):  # noqa: F811
    rows = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    for min_docs, top in ((1, 10), (2, 2), (99, 3)):
        assert found(divergence.audited(odd, min_docs, top)) == audit(rows, min_docs, top)


def test_audit_of_many_sources(spark):
    """Sources without terms, terms of one source, ties of values, and a source with most rows; languages that share sources."""
    rng = np.random.default_rng(5)
    words = [f"w{'abcdefghij'[k % 10] * (k % 23)}" for k in range(60)] + ["Éa", "éa"]
    rows = [("en" if k % 3 else None, f"s{min(int(rng.integers(0, 30)), 12)}", " ".join(words[int(x)] for x in rng.integers(0, 1 + k % 62, k % 40))) for k in range(400)]
    rows += [("xx", "alone", "term"), ("yy", "p", ""), ("yy", "q", "1 2 3"), ("en", "", "one two"), ("en", None, "one two")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert found(divergence.audited(df, 3, 5)) == audit(rows, 3, 5)


def test_audit_of_no_rows(spark, none):  # noqa: F811
    df = divergence.audited(none)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"] and not df.count()


def test_long_text(spark):
    df = spark.createDataFrame([(0, LONG, "en", "a", 0, 0, 0, 0, "", "", ""), (1, LONG[:1000], "en", "b", 0, 0, 0, 0, "", "", "")], SCHEMA)
    assert found(divergence.audited(df, 2, 3)) == audit([("en", "a", LONG), ("en", "b", LONG[:1000])], 2, 3)
