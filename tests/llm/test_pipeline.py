"""The corpus pipeline against a brute-force version of its decisions."""

from test_corpus_operators import roots_of, slow_fingerprint, slow_line_dedup

import corpus_pipeline
from conceptstrata.llm import decontaminate, language
from conceptstrata.llm.common import load


def test_run(spark, sf_small):
    rows = {r.doc_id: r for r in load(spark, sf_small, "documents").collect()}
    named = language.predict(load(spark, sf_small, "documents"), language.fit(load(spark, sf_small, "documents")))
    kept = {r.doc_id for r in named.collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert len(kept) > 0.97 * len(rows)
    texts = slow_line_dedup([(d, rows[d].text) for d in sorted(kept)], 100)
    prints = {d: slow_fingerprint(t) for d, t in texts.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = roots_of(prints, near)
    texts = {d: t for d, t in texts.items() if roots[d] == d}
    items = [decontaminate.normal(r.text) for r in load(spark, sf_small, "benchmark").collect()]
    clean = {d for d, t in texts.items() if not any(i in decontaminate.normal(t) for i in items)}
    got = corpus_pipeline.run(spark, sf_small).collect()
    assert {r.doc_id for r in got} == clean


def test_stages_keep_the_columns(spark, sf_small):
    docs = load(spark, sf_small, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_small).columns == docs.columns
    odd = spark.createDataFrame([(None, "the of and words", "en", None, None), (7, None, None, "s", 0), (7, None, None, "s", 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, odd, sf_small).count() == (2 if name == "simhash_near_dedup" else 3), name


def test_rows_with_null_and_shared_ids(spark, sf_small):
    docs = load(spark, sf_small, "documents")
    item = next(r.text for r in load(spark, sf_small, "benchmark").collect() if len(decontaminate.normal(r.text)) >= 60)
    bird = "a robin sat on the garden wall and sang until the rain began to fall over the hills " * 3
    ship = "every container ship that enters this harbour has to report its cargo to the customs office first " * 3
    rock = "granite forms deep below the surface where molten minerals cool slowly for millions of years " * 3
    moon = "the lunar module left its descent stage behind when both astronauts returned to orbit " * 3
    rows = [(None, bird), (None, ship), (None, ship), (8, rock), (8, moon), (9, bird), (9, bird)]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    got = stages["simhash_near_dedup"](spark, odd, sf_small).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("9", bird), ("None", ship), ("8", rock), ("8", moon)])
    leaked = f"{rock} {item} {rock}"
    rows = [(None, leaked), (None, ship), (8, leaked), (8, moon), (9, bird)]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    got = stages["benchmark_decontamination"](spark, odd, sf_small).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("None", ship), ("8", moon), ("9", bird)])
    found = decontaminate.contamination(odd, load(spark, sf_small, "benchmark"))
    assert {r.doc_id for r in decontaminate.clean(odd, found).collect()} == {9}


def test_run_deletes_whole_runs(spark, sf_small):
    from test_corpus_operators import whole_runs

    docs = load(spark, sf_small, "documents")
    kept = {r.doc_id: r.text for r in language.predict(docs, language.fit(docs)).collect() if r.lang_pred != "und" and r.score >= 0.5}
    texts = whole_runs(sorted(kept.items()), 100)
    prints = {d: slow_fingerprint(t) for d, t in texts.items()}
    roots = roots_of(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    items = [decontaminate.normal(r.text) for r in load(spark, sf_small, "benchmark").collect()]
    clean = {d for d, t in texts.items() if roots[d] == d and not any(i in decontaminate.normal(t) for i in items)}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_small).collect()} == clean
