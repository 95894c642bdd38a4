"""Near copies by Jaccard similarity against a comparison of all pairs."""

import numpy as np
import pytest

from gleaner.llm import jaccard


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))}


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(rows, share=0.8):
    label = {d: d for d, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[i + 1 :]:
            if likeness(s, t) >= share:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {d: find(d) for d in label}


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r["component_id"] for r in jaccard.alike(df).collect()}


def edited(r, words, k):
    out = list(words)
    for at in r.choice(len(out), k, replace=False).tolist():
        out[at] = f"new{r.integers(1 << 40)}"
    return out


@pytest.mark.parametrize("file_sets", [20_000, 4])  # 4: most files are cut into blocks
def test_all_pairs_at_the_bound_and_none_below(spark, monkeypatch, file_sets):
    monkeypatch.setattr(jaccard, "FILE_SETS", file_sets)
    r = np.random.default_rng(5)
    passage, texts = [f"p{k}" for k in range(60)], []
    for b in range(25):
        base = [f"w{b}x{k}" for k in r.integers(0, 400, int(r.integers(5, 160))).tolist()]
        base = base + passage if b % 3 == 0 else base
        texts += [base] + [edited(r, base, min(len(base), k)) for k in (0, 1, 2, 3, 4)]
    hub = [f"h{k}" for k in range(120)]
    texts += [edited(r, hub, int(k)) for k in r.integers(0, 4, 60)]  # one large group
    texts += [[], [], ["one"], ["ONE"], ["one", "two"]]
    # shares of exactly 0.8: 24 words have 20 shingles, and dropping the last 4 leaves 16 of them
    texts += [[f"e{k}" for k in range(24)], [f"e{k}" for k in range(20)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = groups(rows)
    assert likeness(rows[-1][1], rows[-2][1]) == 0.8
    assert got(spark, rows) == want


def test_links_do_not_depend_on_the_number_of_documents(spark):
    r = np.random.default_rng(6)
    rows = [(i, " ".join(f"v{k}" for k in r.integers(0, 10**6, 30).tolist())) for i in range(4000)]
    base = [f"b{k}" for k in range(203)]
    pairs = []
    for k in range(30):
        own = [f"{w}_{k}" for w in base]
        pairs += [(10_000 + 2 * k, " ".join(own)), (10_001 + 2 * k, " ".join(edited(r, own, 4)))]
    near = {b: a for (a, s), (b, t) in zip(pairs[::2], pairs[1::2], strict=True) if likeness(s, t) >= 0.8}
    found = got(spark, rows + pairs)
    assert len(near) > 20 and {d for d, c in found.items() if d != c} == set(near)
    assert all(found[b] == a for b, a in near.items())
