"""Every registered query of the package and the pipeline at the smallest scale, against SQL where there is some."""

import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prefloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROWS = {"op3_main_text": "pages"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name in ORACLES:
        rows = duck.execute(ORACLES[name])
        names = [d[0] for d in rows.description]
        want = [tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in rows.fetchall()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    elif not name.startswith("op10"):
        assert len(got) == duck.execute(f"SELECT count(*) FROM {ROWS.get(name, 'documents')}").fetchone()[0]
    assert not any(isinstance(v, float) and math.isnan(v) for r in got for v in r)


def test_pipeline_stages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [documents]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], SF)
        assert out.dtypes == documents.dtypes
        kept.append(out.persist())
    ids = [Counter(r.doc_id for r in d.select("doc_id").collect()) for d in kept]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(labels.get(i, 1) == 0 or i in ids[1] for i in ids[0] if i in labels)
    text = {r.doc_id: r.text for r in documents.collect()}

    def shingles(i):
        w = text[i].lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    parts = {i: shingles(i) for i in ids[1]}
    near = {(a, b) for a in parts for b in parts if a < b and len(parts[a] & parts[b]) >= 0.8 * len(parts[a] | parts[b])}
    assert sum(a in ids[2] and b in ids[2] for a, b in near) <= 0.02 * len(near)
    gone = set(ids[1]) - set(ids[2])
    for i in gone:  # only near copies go
        assert max(len(parts[i] & p) / len(parts[i] | p) for k, p in parts.items() if k != i) > 0.5
    assert ids[2] == ids[3] == ids[4]
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(ids[4])


def test_near_dedup_of_the_pipeline_is_at_0_8_both_ways(spark):
    from prefloom.llm import simhash

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r.doc_id: simhash.distinct_shingles(r.text or "", 5) for r in documents.collect()}
    left = {r.doc_id for r in corpus_pipeline.keep_distinct(spark, documents, SF).collect()}
    near = [(a, b) for a in sets for b in sets if a < b and simhash.jaccard(sets[a], sets[b]) >= 0.8]
    assert not [p for p in near if left.issuperset(p)]
    assert set(sets) - left <= {i for p in near for i in p}


def test_sequences_follow_the_mixture(spark):
    rows = [(k, "word " * 1000 + str(k % 10), "en", "big" if k < 360 else "small", 5001) for k in range(400)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    packed = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    assert len(packed) == 400 and {r.sequence_id for r in packed} == set(range(200))
    # weights by the square root of the sizes: 3 to 1
    for n in (32, 64, 96):
        early = [r.doc_id for r in packed if r.sequence_id < n]
        assert abs(sum(i < 360 for i in early) / len(early) - 0.75) <= 0.13


def test_pipeline_of_odd_documents(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "token=abcdefghijklmnop " * 3, None, None, 5), (3, "x " * 50_000, "en", "b", 1)]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.count()


def test_packing_follows_the_order_in_which_the_mixture_is_stored(spark):
    from prefloom.llm import mixing
    from prefloom.session import keep

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(k, "word " * 1000 + str(k % 10), "en", "big" if k % 4 else "small", 5001) for k in range(400)]
    docs = spark.createDataFrame(rows, schema)

    def placed(stored):
        packed = sorted(corpus_pipeline.pack_sequences(spark, stored, SF).collect(), key=lambda r: (r.sequence_id, r.doc_id))
        assert len(packed) == 400 and all(r.length == 1002 for r in packed)
        return [{r.doc_id for r in packed[2 * k : 2 * k + 2]} for k in range(200)]

    # any order that a stage before has stored, in several files
    stored = keep(docs.repartitionByRange(7, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")), "falling")
    assert placed(stored) == [{399 - 2 * k, 398 - 2 * k} for k in range(200)]
    order = [r.doc_id for r in mixing.mix(docs).orderBy("slot", "source_rank").collect()]
    mixed = keep(corpus_pipeline.mix_sources(spark, docs, SF), "mixing")
    assert placed(mixed) == [{order[2 * k], order[2 * k + 1]} for k in range(200)]
