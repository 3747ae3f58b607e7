"""Each pipeline stage on the smallest tables, judged on its own input."""

import corpus_pipeline
import pytest

from failcast.llm import decontaminate, pii, simhash, toxicity
from failcast.llm.common import fold, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.stored(stage(spark, frames[-1], SF))
        frames.append(path)
    return frames


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "packing"]
    assert all(f.columns == stages[0].columns for f in stages[:-1])


def test_decisions_take_effect(spark, stages):
    docs, clean, single, cut, masked, packed = stages
    model = toxicity.train(docs.where(fold("doc_id", 5) != 0), table(spark, SF, "labels"))
    scores = docs.select("doc_id", toxicity.toxicity("text", model, spark).alias("s"))
    assert {r.doc_id for r in scores.where("s < 0.5").collect()} == {r.doc_id for r in clean.collect()}
    groups = {r.component_id for r in simhash.simhash_components(clean).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(groups)
    again = decontaminate.contamination(single, table(spark, SF, "benchmark"))
    hit = {r.doc_id for r in again.where("contaminated").collect()}
    before = {r.doc_id: r.text for r in single.collect()}
    assert {r.doc_id for r in cut.collect() if r.text != before[r.doc_id]} == hit
    left = pii.find_pii(masked).agg({"n_email": "sum", "n_card": "sum"}).first()
    assert tuple(left) == (0, 0)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in masked.collect()}


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, fp long, _kept long, _hits string, toxic int"


def odd_tables(spark, folder, rows, labels):
    docs = [(i, t, None, None, len(t or ""), 1, 2, "x", 3) for i, t in rows]
    spark.createDataFrame(docs, CLASHING).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [("i1", " ".join(f"bench{k}" for k in range(12))), ("i1", None), (None, ""), ("i2", "one two")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_rows(spark, tmp_path):
    """Null, empty and long texts, missing and repeated ids, rows in full twice, clashing columns."""
    long = " ".join(f"word{k * 7919 % 10007}" for k in range(60_000))
    bench = "before " + " ".join(f"bench{k}" for k in range(12)) + " after"
    rows = [(1, None), (2, ""), (3, " \t "), (None, None), (None, "no id here"), (None, "no id here"), (4, long), (4, long)]
    rows += [(5, long), (6, bench), (7, "a" * 100_000), (8, "mail me: a.b@example.org"), (9, "\U0001f600 é one two")]
    labels = [(i, None, i % 2) for i in range(1, 8)] + [(None, None, None), (6, 1, None), (8, 0, 5)]
    folder = odd_tables(spark, tmp_path, rows, labels)
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        kept = corpus_pipeline.stored(stage(spark, docs, folder))
        assert kept.columns == docs.columns
        if name == "simhash":
            ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
            # The three texts without words are one group, the two long copies another.
            assert ids == [-1, -1, -1, 1, 4, 6, 7, 8, 9]
        docs = kept
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    assert texts[6].split() == ["before", "after"] and "[EMAIL]" in texts[8] and texts[4] == long
    packed = corpus_pipeline.run(spark, folder)
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0


def test_empty_documents(spark, tmp_path):
    folder = odd_tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
