import importlib
import itertools
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardline.llm.queries import QUERIES
from wardline.llm.shared import Scratch

from .conftest import DOCS

pytest.importorskip("public_tokenizers")


@pytest.fixture
def folder(spark, texts, tmp_path):
    """Tables with planted toxic texts, copies, benchmark items and personal data, null and repeated keys."""
    item = "the benchmark asks which of the seven rivers in the northern valley reaches the eastern sea first of all"
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(1000 + i, f"walk on number {i * 17} stupid scum of stone {i * 31} river", "en", "s", 1) for i in range(25)]
    rows += [(2000 + i, f"a quiet walk number {i * 13} along river {i * 7} and stone {i * 3}", "en", "s", 1) for i in range(240)]
    rows += [(3000, f"before it {item} and after", "en", "s", 1), (None, item.upper(), "en", "s", 1), (None, "a clean text without a key", "en", "s", 1)]
    rows += [(4000, "write to me.you@mail.example.org or +1 (555) 123-4567 😀 soon", "en", "s", 1), (4000, "the same key with another text", "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 1, int(1000 <= r[0] < 2000)) for r in rows if r[0] is not None and 1000 <= r[0] < 3000]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_one_after_the_other(spark, folder):
    found = corpus_pipeline.run(spark, folder).collect()
    assert len(corpus_pipeline.STAGES) == 5
    by_key = {}
    for r in found:
        by_key.setdefault(r.doc_id, []).append(r)
    assert not [k for k in by_key if k is not None and 1000 <= k < 2000]
    assert [k for k in by_key if k is not None and 2000 <= k < 3000] and len([k for k in by_key if k and 2000 <= k < 3000]) == 240
    assert 3000 not in by_key and [r.text for r in by_key[None]] == ["a clean text without a key"]
    assert sorted(r.text for r in by_key[4000]) == ["the same key with another text", "write to <email> or <phone> 😀 soon"]
    assert all(r.n_chars == len(r.text or "") or r.text is None for r in found)
    assert 0 in by_key and 25 not in by_key  # texts 25 to 28 are copies of the first four
    assert all(r.n_tokens == len(r.ids) and r.ids[0] == 1 and r.ids[-1] == 2 for r in found)


def test_ids_are_decoded_and_compared(spark, folder, monkeypatch):
    docs = spark.createDataFrame([(1, "Plain words and more", "en", "s", 1), (2, None, "en", "s", 0), (3, "", "en", "s", 0)], DOCS)
    last = corpus_pipeline.STAGES[-1][1]
    import public_tokenizers

    from wardline.llm import sentencepieces

    model = sentencepieces.read_model(public_tokenizers.path(corpus_pipeline.PIECES))
    trip = docs.select("doc_id", sentencepieces.round_trip(spark, docs.text, model).alias("trip")).select("doc_id", "trip.decoded_same")
    assert {(r.doc_id, r.decoded_same) for r in last(spark, docs, folder).collect()} == {tuple(r) for r in trip.collect()}
    monkeypatch.setattr(sentencepieces, "decoded", lambda spark, ids, model: F.lit("Other words"))
    assert not any(r.decoded_same for r in last(spark, docs, folder).collect())


def test_rows_keep_their_numbers_when_splits_change(spark, folder, tmp_path, monkeypatch):
    """Files are cut into other splits after each table that is written, as when executors come and go."""
    path = str(tmp_path / "parts.parquet")
    corpus_pipeline.not_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).repartition(12).write.parquet(path)
    docs = spark.read.parquet(path)
    stages = dict(corpus_pipeline.STAGES)

    def found(name):
        return sorted((str(r.doc_id), str(r.text)) for r in stages[name](spark, docs, folder).collect())

    names = ["simhash", "decontamination", "personal"]
    expected = {name: found(name) for name in names}
    keep, sizes = Scratch.keep, itertools.cycle(["4k", "128m", "12k"])

    def shifting(self, df, name="table"):
        kept = keep(self, df, name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return kept

    monkeypatch.setattr(Scratch, "keep", shifting)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        assert {name: found(name) for name in names} == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_stages_take_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.where("doc_id < 0"), folder)
        assert none.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert none.columns == docs.columns


def test_queries_are_registered_and_optional(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    for number in range(1, 11):
        assert len([q for q in QUERIES if q.startswith(f"op{number}_")]) == 1
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    without = importlib.reload(entry)
    assert without.queries() and not [q for q in without.queries() if q.startswith("op") and q in QUERIES]
    monkeypatch.undo()
    importlib.reload(entry)
