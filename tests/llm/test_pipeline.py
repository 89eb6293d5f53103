import re

import corpus_pipeline
from larkspur.llm import langid, pii, registry

from .test_simhash import similar


def test_stages_against_brute_force(spark, sf, documents, texts):
    docs, names = documents, documents.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language ID", "exact dedup", "SimHash near-dedup", "PII", "best-fit packing"]
    own = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    docs = corpus_pipeline.written(steps["language ID"](spark, docs, sf), "t")
    assert docs.columns == names
    langs, p, floor = langid.learn(langid.learned_from(documents), floors=True)
    said = dict(zip(texts, langid.Scorer(langs, p).judge(list(texts.values()))))
    one = own(docs)
    assert one == {d: t for d, t in texts.items() if said[d][0] != "und" and said[d][1] >= 0.5 and said[d][2] >= floor[langs.index(said[d][0])] - langid.MARGIN}
    assert len(one) >= 0.98 * len(texts)
    given = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert all(r["lang"] == (given[r["doc_id"]] if said[r["doc_id"]][1] < langid.SURE else said[r["doc_id"]][0]) for r in docs.collect())

    docs = corpus_pipeline.written(steps["exact dedup"](spark, docs, sf), "t")
    best = {}
    for d, t in one.items():
        n = re.sub("[\x20\x09-\x0d]", "", t)
        best[n] = min(best.get(n, (1, 0)), (-len(t), d))
    two = own(docs)
    assert docs.columns == names and set(two) == {d for _, d in best.values()}

    docs = corpus_pipeline.written(steps["SimHash near-dedup"](spark, docs, sf), "t")
    ids = sorted(two)
    three = own(docs)
    assert docs.columns == names and set(three) == {ids[i] for i in similar([two[d] for d in ids])}

    docs = corpus_pipeline.written(steps["PII"](spark, docs, sf), "t")
    judge = pii.judge()
    four = own(docs)
    assert docs.columns == names and four == {d: pii.redact(t, pii.find(t, judge)[1]) for d, t in three.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    rows = steps["best-fit packing"](spark, docs, sf).collect()
    assert {r["doc_id"] for r in rows} == set(four)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, rows)) and {tuple(r)[:5] for r in rows} == {tuple(r)[:5] for r in corpus_pipeline.run(spark, sf).collect()}


def test_nasty(spark, sf, nasty, empty):
    for docs in (nasty, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.schema == docs.schema, name
            docs = corpus_pipeline.written(out, "t")
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()


def test_registered():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and len([q for q in registry.QUERIES if q.startswith("op")]) == 10


def test_sql(spark, sf, duck):
    for name, sql in registry.ORACLES.items():
        df = registry.QUERIES[name](spark, sf)
        columns = sorted(df.columns)
        want = duck.sql(sql).df()
        assert sorted(want.columns) == columns
        assert sorted(map(repr, df.select(*columns).toPandas().itertuples(index=False, name=None))) == sorted(map(repr, want[columns].itertuples(index=False, name=None)))
