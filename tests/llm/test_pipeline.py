"""The pipeline's stages against what each is said to do."""

import re

import corpus_pipeline
import pytest

from loomwork.llm import decontam, packing, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{top}/{k}")
        out.append(spark.read.parquet(f"{top}/{k}"))
    return out


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert steps[-1].columns == [x.split()[0] for x in packing.DDL.split(", ")]


def test_decisions(spark, steps):
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    texts = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in steps[:-1]]
    model = toxicity.train(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids[1] == {r.doc_id for r in toxicity.scores(steps[0], model).collect() if r.score < 0.5}
    prints = {d: simhash.fingerprint((t or "").encode()) & (1 << 64) - 1 for d, t in texts[1].items()}
    group = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            low = min(group[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2)
            changed |= low < group[a]
            group[a] = min(low, group[a])
    assert ids[2] == set(group.values())
    hits = {r.doc_id for r in decontam.contamination(steps[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.contaminated}
    assert ids[3] == ids[2] - hits and ids[4] == ids[3] == ids[5]
    for d, t in texts[4].items():
        assert not re.search(r"[0-9a-z]@[a-z0-9-]+\.[a-z]", t)
    assert steps[5].groupBy().sum("length").first()[0] == sum(len(packing.public_encoder()(t or "")) + 1 for t in texts[4].values())


def test_awkward_and_empty(spark, tmp_path):
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "only this")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = [(None, "a b c", None, None, None), (None, "a b c", None, None, None), (1, None, None, None, None), (1, None, None, None, None), (2, "say only this now", "en", "s", 17), (3, "clean text here", "en", "s", 15)]
    spark.createDataFrame(rows, ddl).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {1, 3, None}


def test_repeated_ids_clashing_columns_and_long_texts(spark, tmp_path):
    import random

    g = random.Random(9)
    word = lambda: "".join(g.choice("abcdefghijklmnop") for _ in range(7))
    texts = [" ".join(word() for _ in range(40)) for _ in range(6)]
    long = " ".join(word() for _ in range(30_000))
    rows = [(1, texts[0], "en", "b"), (1, texts[0], "en", "a"), (1, texts[1], "en", "c"), (2, texts[0], "en", "d"), (3, texts[2], "fr", "e"), (4, texts[2], "fr", "f"), (5, long, "en", "g"), (6, long, "en", "h"), (7, "", "en", "i"), (8, None, "en", "j")]
    rows = [(d, t, x, "s", len(t or ""), s, 1.0, 2, 3, 4, "r") for d, t, x, s in rows]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, h string, score double, id long, row long, component_id long, rank string"
    docs = spark.createDataFrame(rows, ddl)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(texts[2].split()[5:25]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(1, texts[0], "a"), (1, texts[1], "c"), (3, texts[2], "e"), (5, long, "g"), (7, "", "i")}
    for parts in (1, 5):
        out = corpus_pipeline.near_duplicates_out(spark, docs.repartition(parts), str(tmp_path))
        assert out.columns == docs.columns and {(r.doc_id, r.text, r.h) for r in out.collect()} == want
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], ddl).schema], name
    assert {r.doc_id for r in docs.collect()} == {1, 5, 7}
    pieces = corpus_pipeline.packed(spark, docs, str(tmp_path))
    assert pieces.where("doc_id = 5").agg({"length": "sum"}).first()[0] == len(packing.public_encoder()(long)) + 1
