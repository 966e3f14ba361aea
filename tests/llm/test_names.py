"""Columns of the input that have the names operators use inside."""

import pytest

from tidegauge.llm import exact_dedup, pii, quality_rules, sharding, simhash, toxicity

HIDDEN = ["__counts", "__lines", "__sha", "__keep", "__size", "__n", "__prefix", "__s", "__rows", "__key", "__slot", "__first",
          "__place", "__id", "__m", "__mark", "__row", "__terms", "__fold", "text_mark", "found", "plain_text", "n", "prefix",
          "sha", "rows", "mark", "root", "fp", "node", "term", "entity", "top_rows", "version", "bytes", "units", "number"]

OPERATORS = {
    "quality_rules": quality_rules.line_quality,
    "pii": pii.sanitise,
    "mark_duplicates": exact_dedup.mark_duplicates,
    "distinct_documents": exact_dedup.distinct_documents,
    "shard_records": sharding.shard_records,
    "one_of_each": simhash.one_of_each,
    "toxicity": lambda docs: toxicity.score_documents(docs, toxicity.Linear(toxicity.np.zeros(1 << toxicity.BITS), 0.0)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_stay_and_results_are_the_same(spark, name):
    texts = ["Same text, mail a@b.org.", "same text, mail a@b.org.", "Other words. " * 30, None, "", "Alone here."]
    plain = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x"), (5, "Alone here.")], "doc_id long, text string")
    clashing = plain.selectExpr("*", *[f"concat('{c}', doc_id) as `{c}`" for c in HIDDEN])
    run = OPERATORS[name]
    expected = run(plain)
    columns = expected.columns
    found = run(clashing)
    rows = found.collect()
    assert sorted(str([r[c] for c in columns]) for r in rows) == sorted(str(list(r)) for r in expected.collect())
    assert sorted(found.columns) == sorted([*columns, *HIDDEN])
    for r in rows:
        assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for c in HIDDEN)
