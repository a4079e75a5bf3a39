"""The stages against brute force, each on what its predecessor kept."""

import re

import corpus_pipeline
import pandas as pd
from ravelin.llm import mixing, toxicity
from ravelin.llm.queries import QUERIES, tokenizer_path
from ravelin.llm.tokens import encoder

from .test_dedup import brute_print, classes

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    kept = {}
    rejected = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        out = stage(spark, docs, SF)
        rows = out.toPandas()
        if name == "packing":
            break
        assert out.columns == columns
        texts = before.set_index("doc_id").text
        if name == "toxicity":
            want = set(before.doc_id) - rejected
        elif name == "exact dedup":
            norm = texts.map(lambda t: re.sub("[\x20\x09-\x0d]+", " ", t))
            want = set(pd.Series(norm.index, index=norm.to_numpy()).groupby(level=0).min())
        elif name == "simhash near-dedup":
            prints = texts.map(brute_print).to_dict()
            want = set(classes(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3).values())
        else:
            copies = {r.doc_id: r.copies for r in mixing.plan(docs).collect()}
            assert rows.doc_id.value_counts().to_dict() == {i: n for i, n in copies.items() if n}
            want = {i for i, n in copies.items() if n}
        assert set(rows.doc_id) == want and all(texts[r.doc_id] == r.text for r in rows.itertuples())
        kept[name] = rows
        docs = spark.createDataFrame(rows, docs.schema)
    ids = encoder(tokenizer_path("byte_bpe_50k.json"))
    assert rows.length.sum() == sum(len(ids.encode(t)) // 4 + 1 for t in kept["mixing"].text)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}


def test_stages_bear_awkward_rows(spark, awkward, empty):
    for table in (awkward, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            rows = docs.collect()
            assert bool(rows) == (table is awkward), name
            docs = spark.createDataFrame(rows, docs.schema)


def pipeline(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    return docs


def counts(df):
    return df.groupBy("doc_id", "text").count().toPandas().sort_values(["doc_id", "text"]).to_numpy().tolist()


def test_stages_chain_without_writes_between(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lazy, written = pipeline(spark, docs), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, written, SF).write.parquet(str(tmp_path / name))
        written = spark.read.parquet(str(tmp_path / name))
    # Unwritten rows have no place in a file, so rows that tie may be chosen and sampled otherwise.
    assert {r.doc_id for r in lazy.select("doc_id").distinct().collect()} and abs(lazy.count() - written.count()) <= 0.02 * written.count()


def test_two_pipelines_at_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    alone = counts(pipeline(spark, docs))
    with ThreadPoolExecutor(2) as pool:
        both = list(pool.map(lambda _: counts(pipeline(spark, docs)), range(2)))
    assert both == [alone, alone]


def test_keys_tell_rows_of_files_apart_and_copy_nothing(spark, tmp_path):
    from ravelin.llm.base import keyed

    rows = [(1, "a"), (1, "a"), (None, None), (2, "b")] * 50
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    told, key = keyed(docs, "rows")
    assert told.columns == [*docs.columns, key] and told.select(key).distinct().count() == 200
    first, again = ({tuple(r) for r in told.collect()} for _ in range(2))
    assert first == again
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "docs") in plan or "docs" in plan
    other, key = keyed(docs.union(docs), "rows")
    assert other.select(key).distinct().count() == 400
