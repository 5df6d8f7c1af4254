"""The pipeline's stages on a small table: each decision takes effect, clean documents stay."""

from __future__ import annotations

import re

import corpus_pipeline
from kinsift.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    own = {r.doc_id: r for r in docs.collect()}
    left = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, SF)
        rows = current.collect()
        left[name] = rows
        if name != "mixing":
            assert current.columns == columns
        current = spark.createDataFrame(rows, current.schema)
    toxic = {r.doc_id for r in queries.op3_toxicity(spark, SF).collect() if r.predicted}
    ids = {n: [r.doc_id for r in rows] for n, rows in left.items()}
    assert set(ids["toxicity"]) == set(own) - toxic and len(ids["toxicity"]) == len(set(ids["toxicity"]))
    assert set(ids["near_dedup"]) < set(ids["toxicity"])
    hit = {r.doc_id for r in queries.op8_decontaminate(spark, SF).collect() if r.contaminated}
    assert set(ids["decontamination"]) == set(ids["near_dedup"]) - hit
    assert sorted(ids["secrets"]) == sorted(ids["decontamination"])
    for r in left["secrets"]:
        assert r.n_chars == len(r.text) and not re.search(r"token = \"[0-9a-f]{40}", r.text)
        if "[SECRET]" not in r.text:
            assert r.text == own[r.doc_id].text
    assert set(ids["mixing"]) <= set(ids["secrets"]) and len(ids["mixing"]) > 0.5 * len(ids["secrets"])


def test_clashing_columns_nulls_and_empty_tables(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, hits long, copy_no string, Shuffle_Key int, `a.b` string"
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(k, words(k, 30) + (" vilegunk" if k % 4 == 0 else ""), "en", "s", 1, "t", k, "c", 7, "d") for k in range(80)]
    rows += [(200, words(1, 30), "en", "s", 1, "t", 200, "c", 7, "d"), (201, words(2, 30) + " " + item, "en", "s", 1, "t", 201, "c", 7, "d"), (202, words(3, 40) + " token = abcdefgh", None, None, None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None, None, None), (203, words(203, 30), "en", "s", 1, "t", 203, "c", 7, "d"), (203, words(203, 30), "en", "s", 1, "t", 203, "c", 7, "d")]
    docs = spark.createDataFrame(rows, kind)
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(80)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item), (2, None), (None, "x")], "item_id long, text string")
    for name, d, l, b in (("full", docs, labels, bench), ("empty", docs.limit(0), labels.limit(0), bench.limit(0))):
        sf = str(tmp_path / name)
        for table, df in (("documents", d), ("labels", l), ("benchmark", b)):
            df.write.parquet(f"{sf}/{table}.parquet")
        out = corpus_pipeline.run(spark, sf)
        assert out.columns == [*docs.columns, "copy_no_", "n_copies", "shuffle_key_"]
        got = out.collect()
        if name == "empty":
            assert not got
            continue
        ids = {r.doc_id for r in got}
        kept = {k for k in range(80) if k % 4} | {202, 203, None}
        assert ids <= kept and len(ids) > 0.4 * len(kept)
        assert all(r.toxicity == "t" and r.hits == r.doc_id and r["Shuffle_Key"] == 7 and r["a.b"] == "d" for r in got if r.doc_id not in (202, None))
        assert all("[SECRET]" in r.text and r.n_chars == len(r.text) for r in got if r.doc_id == 202)
        assert max(r["copy_no_"] for r in got) == max(r.n_copies for r in got) - 1


def test_a_stage_by_itself_bounds_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(name, 10_000)
            stage(spark, docs, SF)
            assert int(spark.conf.get(name)) == corpus_pipeline.BATCH_ROWS
            spark.conf.set(name, 100)  # a smaller one is left as it is
            corpus_pipeline.in_small_batches(lambda s, d, _: d)(spark, docs, SF)
            assert spark.conf.get(name) == "100"
    finally:
        spark.conf.set(name, before)
