"""The pipeline's stages against plain Python on the smallest documents, and the stages' contract."""

import functools
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from gleaner.llm import ranker
from gleaner.llm.shared import written
from tests.llm.test_jaccard import shingles
from tests.llm.test_operators import docs, fingerprint, measures, none, odd, words  # noqa: F401


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir), name))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[:-1])


def test_quality_rules_stage(stages):
    want = {d for d, t in texts(stages[0]).items() if (m := measures(t))[0] >= 20 and 100 * m[4] <= 30 * m[0]}
    assert set(texts(stages[1])) == want  # no host of the test data fails


def test_ranker_stage(spark, sf_dir, stages):
    model = ranker.trained(stages[1], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r["doc_id"] for r in ranker.scored(stages[1], model).where("predicted = 1").collect()}
    assert set(texts(stages[2])) == good


def test_line_stage(stages):
    before = {r["doc_id"]: r for r in stages[2].collect()}
    sites = defaultdict(set)
    for r in before.values():
        for x in r["text"].split("\n"):
            if words(x):
                sites[x.strip(" \t\n\x0b\x0c\r")].add(r["source"])
    seen = set()
    for d in sorted(before):
        kept = []
        for x in before[d]["text"].split("\n"):
            bare = x.strip(" \t\n\x0b\x0c\r")
            if bare and len(sites[bare]) >= 10:
                if bare in seen:
                    continue
                seen.add(bare)
            kept.append(x)
        before[d] = "\n".join(kept)
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages[3].collect()}
    assert after == {d: (t, len(t)) for d, t in before.items()}


def test_near_copy_stage(stages):
    """One document of each group: of fingerprints within three bits, and of texts with a similarity of 0.8 or more, by all pairs."""
    rows = texts(stages[3])
    ids = sorted(rows)
    three = {d: fingerprint(rows[d]) for d in ids}
    near = lambda a, b: bin(three[a] ^ three[b]).count("1") <= 3
    sets = {d: shingles(rows[d] or "") for d in ids}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    want = {d for d in ids if first(ids, near)[d] == d and first(ids, alike)[d] == d}
    got = texts(stages[4])
    assert set(got) == want
    assert len(set(got.values())) == len(got) < len(ids)


@functools.cache
def _labels(ids, link):
    label = {d: d for d in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if link(a, b):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def first(ids, link):
    """The smallest id that links reach, for each id."""
    return _labels(tuple(ids), link)


def test_stages_take_odd_rows(spark, sf_dir, odd, none):
    """Nulls, repeats, very long texts and clashing columns go through all stages; an empty table does too."""
    for start, some in ((odd, True), (none, False)):
        docs = start
        for name, f in corpus_pipeline.STAGES[:-1]:
            out = written(f(spark, docs, sf_dir), name)
            assert out.dtypes == docs.dtypes
            docs = out
        packed = written(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir), "packed")
        assert (packed.count() > 0) == some == (docs.count() > 0)


def test_work_tables_go_with_the_next_stage(spark, sf_dir, docs):
    from gleaner.llm import shared

    app = spark.sparkContext.applicationId
    small = docs.limit(60)
    first_out = written(corpus_pipeline.STAGES[0][1](spark, small, sf_dir), "kept")
    left = list(shared._LEFT[app])
    assert left and all(spark.read.parquet(p).count() >= 0 for p in left[:1])
    second = corpus_pipeline.STAGES[1][1](spark, first_out, sf_dir)
    assert second.count() <= first_out.count()  # the stage's input, written since, is still there
    with pytest.raises(Exception, match="(?i)exist|path"):
        spark.read.parquet(left[0]).count()
    # a stage whose input reads the work tables of the one before leaves them
    unwritten = corpus_pipeline.STAGES[0][1](spark, small, sf_dir)
    assert corpus_pipeline.STAGES[1][1](spark, unwritten, sf_dir).count() == second.count()


def test_packing_stage(stages):
    by = defaultdict(list)
    for r in stages[5].collect():
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in places) <= 2048 for places in by.values())
    assert Counter(r["doc_id"] for r in stages[5].where("piece = 0").collect()) == Counter(list(texts(stages[4])))


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    keys = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r[k] for k in keys) for r in corpus_pipeline.run(spark, sf_dir).collect()) == Counter(tuple(r[k] for k in keys) for r in stages[5].collect())
