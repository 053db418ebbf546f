"""The pipeline's stages on the smallest tables: decisions take effect and columns stay."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rosterlens.llm import minhash, secrets, simhash

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="generated tables absent")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
        if name == "near duplicates":
            left = simhash.near_duplicates(docs).groupBy("component_id").count()
            assert left.where("count > 1").count() == 0
    assert secrets.scan(docs, [0.0] * len(secrets.ALPHABET) ** 2).where("size(base_spans) > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == n


@pytest.mark.parametrize("place", range(len(corpus_pipeline.STAGES)))
def test_empty_table(spark, place):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[place][1](spark, docs, FOLDER).count() == 0


def test_near_copies_against_brute_force(spark):
    """Edited copies of texts: one of each group that five-word shingles of Jaccard 0.8 or more link is kept."""
    rng = random.Random(3)
    texts = [None, "", " ", "one two", "One  two", "one two three"]
    for n in [5, 6, 9, 20, 60, 200, 1000] * 4:
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts.append(" ".join(base))
        for edits in (1, n // 60, n // 40, n // 25, n // 10):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(n)] = f"v{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    hot = [f"h{rng.randrange(5000)}" for _ in range(100)]
    for _ in range(400):  # a large group of near copies, held against one document in several parts
        copy = list(hot)
        copy[rng.randrange(100)] = f"v{rng.randrange(5000)}"
        texts.append(" ".join(copy))

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                group[max(find(a), find(b))] = min(find(a), find(b))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, FOLDER).collect()}
    assert kept == {find(i) for i in range(len(texts))}


def test_no_row_for_each_pair_of_a_group(spark, monkeypatch):
    """A hot group of copies too far edited to link: what meets what is worked out in tasks, of large buckets part by part."""
    rng = random.Random(4)
    base = [f"h{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for k in range(300):
        copy = list(base)
        for _ in range(rng.randrange(2, 9)):
            copy[rng.randrange(120)] = f"v{k} {rng.randrange(5000)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    group = list(range(300))
    for a in range(300):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) and group[a] != group[b]:
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    asked = []
    whole = minhash._alike
    monkeypatch.setattr(minhash, "_alike", lambda pairs, *rest: (asked.append(pairs.count()), whole(pairs, *rest))[1])
    for tile in (minhash.TILE, 16):
        monkeypatch.setattr(minhash, "TILE", tile)
        found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 5, 0.8).collect()}
        assert found == dict(enumerate(group))
    assert 1 < len(set(group)) < 300 and len(asked) == 4 and max(asked) <= 300 * minhash.BANDS


def test_few_links_stay_in_few_tasks(spark):
    """A few links in the many partitions of a large job: each task before a shuffle would leave files of its own."""
    options = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame([(i, i + 10) for i in range(100)], "a long, b long")
        found = simhash.contracted(links)
        assert {(r.node, r.root) for r in found.collect()} == {(i, i % 10) for i in range(10, 110)}
        assert found.rdd.getNumPartitions() <= 16
        assert simhash.contracted(links.where("a < 0")).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_packing_of_many_documents_in_one_task(spark):
    docs = spark.range(0, 30_000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('the cat ', cast(1 + id % 40 as int))").alias("text"))
    rows = corpus_pipeline.packed(spark, docs, "").toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(rows.doc_id) == list(range(30_000)) and (rows.offset + rows.length).max() <= 2048
    assert (rows.offset == rows.groupby("sequence_id")["length"].cumsum() - rows.length).all()
