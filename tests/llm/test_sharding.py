"""Shards against SQL and a plain simulation; manifests; odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from glimset.llm import sharding
from tests.conftest import same_rows


def test_matches_sql(spark, duck, sf_dir):
    found = sharding.op1_sharding(spark, sf_dir)
    same_rows(found, duck.sql(sharding.ORACLE))
    levels = {r[0] for r in found.select("level").distinct().collect()}
    assert {0, 1, 2} <= levels or len(levels) > 2  # runs that wait, and shards of both tiers


def simulate(sizes, run, target, fanout, rounds):
    """(shard, level) of each run, by merging lists."""
    shards = [(k, s, [k]) for k, s in enumerate(sizes)]
    level = dict.fromkeys(range(len(sizes)), 0)
    for _ in range(rounds):
        tiers = {}
        for shard in shards:
            tier = -1 if shard[1] >= target * 3 // 4 else sum(shard[1] >= int(run * fanout ** (t - 0.5)) for t in range(1, rounds + 2))
            tiers.setdefault(tier, []).append(shard)
        shards = []
        for tier, own in tiers.items():
            whole = len(own) // fanout * fanout if tier >= 0 else 0
            for k in range(0, whole, fanout):
                group = own[k : k + fanout]
                members = sum((g[2] for g in group), [])
                shards.append((group[0][0], sum(g[1] for g in group), members))
                for m in members:
                    level[m] += 1
            shards += own[whole:]
        shards.sort()
    return {m: (s[0], level[m]) for s in shards for m in s[2]}


def test_plan_is_the_simulation(spark):
    sizes = [100 + k * 37 % 90 for k in range(83)] + [0, 3000, 450, 460, 470, 480]
    df = spark.createDataFrame(list(enumerate(sizes)), "shard long, bytes long")
    got = {r.shard: (r["into"], r.level) for r in sharding.plan_merges(df, 130, 2080, 4).collect()}
    assert got == simulate(sizes, 130, 2080, 4, 2)


def run_of(doc, runs):
    return int(hashlib.md5(str(doc).encode()).hexdigest()[:8], 16) % runs


def test_arrivals_and_compaction(spark, documents, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", run_bytes=1000, target_bytes=16_000, fanout=4)
    docs = documents(*[(k, "x" * (50 + k % 50)) for k in range(600)])
    for k in range(3):
        store.append(docs.filter(F.col("doc_id") % 3 == k))
    before = store.manifest()
    merged = store.compact()
    assert (before["version"], merged["version"]) == (3, 4) and merged["shards"] < before["shards"] / 3
    assert store.compact()["version"] in (4, 5)
    live = store.live().collect()
    assert sum(r.rows for r in live) == 600 and max(r.bytes for r in live) < 2 * 16_000
    rows = store.read()
    assert sorted(r.doc_id for r in rows.collect()) == list(range(600)) and rows.columns == [*docs.columns, "in"]
    sizes = {(r[0], r[1], r[2]) for r in rows.groupBy("in.shard").agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).collect()}
    assert sizes == {(r.shard, r.rows, r.bytes) for r in live} == {tuple(r.x)[:1] + tuple(r.x)[2:] for r in rows.select(F.col("in").alias("x")).distinct().collect()}
    assert store.read(3).count() == 600  # an older version is still there
    store.vacuum()
    assert store.read(3).count() == 600  # and stays, as it is young
    store.vacuum(0)
    assert store.versions() == [store.manifest()["version"]] and store.read().count() == 600
    assert len(list((tmp_path / "s" / "lists").iterdir())) == 1


CLASHES = ["shard", "generation", "in", "goes", "task", "into", "x", "in_shard", "in_generation", "__rows", "__level", "__bytes", "__into", "__shard", "level", "rows", "bytes", "Shard"]


def test_names_that_clash(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", run_bytes=100, target_bytes=1600)
    make = lambda names, at: spark.createDataFrame([(at + k, "x" * 40, *[f"{n}{at + k}" for n in names]) for k in range(60)], ["doc_id", "text", *names])
    store.append(make(["other"], 0))
    store.append(make(CLASHES[:-1], 100))  # a later arrival with columns of other names, those of the store among them
    store.append(make([], 200))
    assert store.compact()["shards"] < 40
    rows = {r.doc_id: r.asDict() for r in store.read().collect()}
    assert len(rows) == 180 and store.read().columns[-1] == "in_"
    for i, r in rows.items():
        assert r["other"] == (f"other{i}" if i < 100 else None)
        assert all(r[c] == (f"{c}{i}" if 100 <= i < 200 else None) for c in CLASHES[:-1])
    with pytest.raises(ValueError, match="another type"):
        store.append(make([], 0).withColumn("other", F.lit(1)))


def test_one_id_with_most_rows(spark, tmp_path):
    """A third of all rows has one id, another none: several shards get them."""
    df = spark.range(0, 30_000, 1, 16).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", run_bytes=4000, target_bytes=64_000)
    store.append(df)
    rows = store.read()
    assert rows.count() == 30_000 and rows.groupBy("in.shard").count().agg(F.max("count")).first()[0] < 3000
    assert rows.filter("doc_id = 7").select("in.shard").distinct().count() > 10 and rows.filter("doc_id IS NULL").select("in.shard").distinct().count() > 10


def test_two_writers(spark, documents, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    base = store.manifest()
    store.append(documents((1, "a")))
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(store.live(), base)
    assert store.versions() == [1]


def test_odd_rows(spark, documents):
    docs = documents((1, None), (2, ""), (3, "a"), (3, "a"), (None, "b"), (None, None), (4, "y" * 300_000))
    rows = sharding.sharded(docs, run_bytes=1000, target_bytes=4000)
    assert sorted(str(r[:3]) for r in rows.select(docs.columns).collect()) == sorted(str(r[:3]) for r in docs.collect())
    assert sharding.sharded(docs.limit(0)).count() == 0 and sharding.sharded(docs.limit(0)).columns == rows.columns
