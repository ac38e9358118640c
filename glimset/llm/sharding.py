"""Sharding by size-tiered compaction under a versioned manifest.

``append`` writes an arrival as small immutable shards (runs) of about ``run_bytes`` of text: a row's
run is a hash of its id, so that a run takes from all over its arrival. ``compact`` merges runs of
similar size: within a tier (sizes within a factor of ``fanout``), every ``fanout`` neighbours become
one shard of the next tier, until shards are near ``target_bytes``; what has too few neighbours waits
for more arrivals. All tiers are planned first, on one row a shard, so that a row is rewritten once a
compaction. Both end with a commit: the list of live shards is a Parquet table, and the manifest that
names it gets the next version, which one writer alone can claim. Readers see the shards of one version;
old files stay until ``vacuum``.

Text is shuffled once by an append (by run) and once by a compaction (by shard). The planning windows
run over lanes of ``LANE`` consecutive runs, so that none grows with the store. Generations of shards
with the same columns are one scan, however many they are.

Defined cases: a null text has no bytes; rows without an id go by their text and the part of the input
that they are read in; a run that gets far more rows than the others (one id may hold a third of them)
is cut into several by the part of the input, so that no task has them all; repeated rows are kept, all of them; a text larger
than a target makes a shard of its own size; an empty arrival adds no shard. Columns of any name are kept:
the store's own columns get free names. Arrivals may have other columns than those before (where one
lacks a column it is null), but not other types of the same.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glimset.sources.shared import shuffles_removed

from ._common import hash32, shared_path, write_table

LANE = 4096
FEW = 100_000
MOST_TASKS = 50_000
#: A run is cut if it has so many times the mean run's rows, and this many more.
HOT, HOT_ROWS = 8, 1000
LIVE = ("generation", "shard", "level", "rows", "bytes")
LIVE_KIND = "generation string, shard long, level int, rows long, bytes long"


def run_of(key: Column, runs: int) -> Column:
    return hash32(key) % F.lit(runs)


def free_name(base: str, taken: list[str]) -> str:
    """``base``, with as many underscores as make it differ from all taken names (in any case)."""
    names = {c.lower() for c in taken}
    while base.lower() in names:
        base += "_"
    return base


def tier_of(size: Column, run_bytes: int, fanout: int, rounds: int) -> Column:
    """0 for about a run, 1 for about fanout runs, and so on; borders lie between, as integers."""
    return sum(((size >= int(run_bytes * fanout ** (t - 0.5))).cast("int") for t in range(1, rounds + 2)), F.lit(0))


def plan_merges(shards: DataFrame, run_bytes: int, target_bytes: int, fanout: int) -> DataFrame:
    """(shard, into, level) for shards (shard, bytes): what each becomes part of, after how many merges."""
    rounds = max(0, round(math.log(target_bytes / run_bytes, fanout)))
    plan = shards.select("shard", "bytes", F.col("shard").alias("into"), F.lit(0).alias("level"))
    for _ in range(rounds):
        now = plan.groupBy("into").agg(F.sum("bytes").alias("bytes"))
        now = now.select("into", F.expr(f"into div {LANE}").alias("lane"), F.when(F.col("bytes") >= target_bytes * 3 // 4, -1).otherwise(tier_of(F.col("bytes"), run_bytes, fanout, rounds)).alias("tier"))
        tier = Window.partitionBy("lane", "tier")
        now = now.withColumn("place", F.row_number().over(tier.orderBy("into")) - 1).withColumn("n", F.count(F.lit(1)).over(tier)).withColumn("nth", F.expr(f"place div {fanout}"))
        merged = (F.col("tier") >= 0) & (F.col("nth") < F.expr(f"n div {fanout}"))
        now = now.select(F.col("into").alias("was"), F.when(merged, F.min("into").over(Window.partitionBy("lane", "tier", "nth"))).otherwise(F.col("into")).alias("now"), merged.cast("int").alias("more"))
        plan = plan.join(now, F.col("into") == F.col("was")).select("shard", "bytes", F.col("now").alias("into"), (F.col("level") + F.col("more")).alias("level"))
    return plan.select("shard", "into", "level")


class ShardStore:
    """A store of shards under ``root``: ``data/`` holds generations of shards in a folder for each set of
    columns, ``lists/`` tables of live shards (generation, shard, level, rows, bytes), ``claims/`` the
    versions that writers have claimed, and ``manifests/`` the versions."""

    def __init__(self, spark: SparkSession, root: str, run_bytes: int = 4 << 20, target_bytes: int = 64 << 20, fanout: int = 4):
        self.spark, self.root = spark, root.rstrip("/")
        self.run_bytes, self.target_bytes, self.fanout = run_bytes, target_bytes, fanout
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests

    def _names(self, folder: str) -> list:
        at = self._path(f"{self.root}/{folder}")
        return list(self._files.listStatus(at)) if self._files.exists(at) else []

    def versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self._names("manifests")]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version (the latest, if None; an empty one before any commit)."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "columns": {}, "shards": 0, "runs": 0, "list": None, "generations": {}}
        source = self._files.open(self._path(f"{self.root}/manifests/v{version:010d}.json"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def _put(self, path, text: str) -> None:
        """Creates a file that mustn't be there yet."""
        out = self._files.create(path, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _commit(self, live: DataFrame, base: dict, **changes) -> dict:
        """Writes the list of live shards, claims the version after base's, and renames the manifest into its place."""
        where = f"{self.root}/lists/{uuid.uuid4().hex}"
        listed = write_table(live.select(*LIVE).coalesce(1), where)
        known = base["generations"] | changes.pop("generations", {})
        named = [r[0] for r in listed.select("generation").distinct().collect()]
        manifest = base | changes | {"version": base["version"] + 1, "list": where, "shards": listed.count(), "generations": {g: known.get(g) for g in sorted(named)}}
        name = f"v{manifest['version']:010d}"
        final, draft = self._path(f"{self.root}/manifests/{name}.json"), self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        try:
            self._put(self._path(f"{self.root}/claims/{name}"), "")
        except Exception as e:
            raise RuntimeError(f"version {manifest['version']} was committed by another writer") from e
        self._put(draft, json.dumps(manifest))
        if self._files.exists(final) or not self._files.rename(draft, final):
            raise RuntimeError(f"version {manifest['version']} was committed by another writer")
        return manifest

    def live(self, version: int | None = None) -> DataFrame:
        """The live shards of a version."""
        manifest = self.manifest(version)
        if manifest["list"]:
            return self.spark.read.schema(LIVE_KIND).parquet(manifest["list"])
        return self.spark.createDataFrame([], LIVE_KIND)

    # data

    def _shape(self, schema: StructType) -> dict:
        """Where rows of a schema are kept, and the free names of the two columns that say in which generation and shard."""
        own = [free_name("generation", schema.names), free_name("shard", schema.names)]
        text = json.dumps([schema.jsonValue(), own])
        return {"folder": hashlib.md5(text.encode()).hexdigest(), "schema": schema.jsonValue(), "by": own}

    def _write(self, rows: DataFrame, shape: dict, generation: str) -> DataFrame:
        """Writes rows (with the shape's shard column) as a generation; returns it."""
        path = f"{self.root}/data/{shape['folder']}/{shape['by'][0]}={generation}"
        with shuffles_removed(self.spark):
            rows.write.option("compression", "zstd").partitionBy(shape["by"][1]).parquet(path)
        return self._scan(shape, [generation])

    def _scan(self, shape: dict, generations: list[str]) -> DataFrame:
        base = f"{self.root}/data/{shape['folder']}"
        schema = StructType.fromJson(shape["schema"]).add(shape["by"][0], "string").add(shape["by"][1], "long")
        paths = [f"{base}/{shape['by'][0]}={g}" for g in generations]
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths)

    def _rows(self, manifest: dict, shards: DataFrame, extra: str) -> DataFrame:
        """Rows of the listed shards (generation, shard, x), with all columns of the store in its order, and ``extra``: x."""
        few = shards.limit(FEW + 1).count() <= FEW
        shapes: dict[str, tuple[dict, list[str]]] = {}
        for g, shape in manifest["generations"].items():
            shapes.setdefault(shape["folder"], (shape, []))[1].append(g)
        found = None
        for shape, generations in shapes.values():
            df = self._scan(shape, generations)
            at = [free_name(c, df.columns) for c in ("in_generation", "in_shard", extra)]
            listed = shards.select(F.col("generation").alias(at[0]), F.col("shard").alias(at[1]), F.col("x").alias(at[2]))
            df = df.join(F.broadcast(listed) if few else listed, (F.col(shape["by"][0]) == F.col(at[0])) & (F.col(shape["by"][1]) == F.col(at[1])))
            own = StructType.fromJson(shape["schema"]).names
            df = df.select(*[F.col(c) if c in own else F.lit(None).cast(kind).alias(c) for c, kind in manifest["columns"].items()], F.col(at[2]).alias(extra))
            found = df if found is None else found.union(df)
        return found

    def append(self, rows: DataFrame, key: str = "doc_id", text: str = "text") -> dict:
        """Writes rows as runs and commits them."""
        base = self.manifest()
        columns = base["columns"] | {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        changed = [c for c, kind in base["columns"].items() if columns[c] != kind]
        if changed:
            raise ValueError(f"columns of another type than before: {changed}")
        shape = self._shape(rows.schema)
        total, n = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count(F.lit(1))).first()
        runs = max(1, -(-total // self.run_bytes))
        loose = F.concat_ws("|", F.spark_partition_id().cast("string"), F.coalesce(F.col(text).cast("string"), F.lit("")))
        run = run_of(F.coalesce(F.col(key).cast("string"), loose), runs)
        hot = rows.groupBy(run.alias("run")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT * n // runs + HOT_ROWS)
        cut = [(r.run, -(-r.n * runs // n)) for r in hot.orderBy("run").collect()] if runs > 1 else []  # fewer than an eighth of the runs
        number = run
        for k, (which, parts) in enumerate(cut):
            first = runs + sum(p for _, p in cut[:k])
            number = F.when(run == which, first + F.pmod(F.xxhash64(F.spark_partition_id(), F.col(text)), F.lit(parts))).otherwise(number)
        runs += sum(p for _, p in cut)
        tasks = min(MOST_TASKS, -(-runs // self.fanout))
        name, by = f"g{base['version'] + 1:010d}-{uuid.uuid4().hex[:8]}", shape["by"][1]
        placed = rows.withColumn(by, (number + F.lit(base["runs"])).cast("long"))
        written = self._write(placed.repartitionById(tasks, F.pmod(F.col(by), F.lit(tasks)).cast("int")), shape, name) if n else None
        live = self.live()
        if n:
            shards = written.groupBy(F.col(by).alias("shard")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("bytes"))
            live = live.select(*LIVE).union(shards.withColumns({"generation": F.lit(name), "level": F.lit(0)}).select(*LIVE))
        return self._commit(live, base, columns=columns, runs=base["runs"] + runs, generations={name: shape})

    def compact(self) -> dict:
        """Merges what the tiers allow and commits the result, if there is anything to merge."""
        base, live = self.manifest(), self.live()
        plan = plan_merges(live.select("shard", "bytes"), self.run_bytes, self.target_bytes, self.fanout)
        todo = write_table(live.join(plan.withColumnRenamed("level", "more"), "shard"), f"{self.root}/lists/plan-{uuid.uuid4().hex}")
        merging = todo.filter("more > 0")
        # a shard that others go into is itself merged by as many rounds
        into = merging.groupBy("into").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.max(F.col("level") + F.col("more")).alias("level"))
        # each shard's task, so that none gets several because their hashes meet; the window sees one row a shard
        into = into.withColumn("task", F.row_number().over(Window.orderBy("into")) - 1)
        shards = into.count()
        if not shards:
            return base
        moves = merging.join(into.select("into", "task"), "into").select("generation", "shard", F.struct("into", "task").alias("x"))
        goes = free_name("goes_to", list(base["columns"]))
        rows = self._rows(base, moves, goes)
        shape, name = self._shape(rows.drop(goes).schema), f"g{base['version'] + 1:010d}-{uuid.uuid4().hex[:8]}"
        rows = rows.withColumn(shape["by"][1], F.col(f"{goes}.into"))
        written = self._write(rows.repartitionById(min(shards, MOST_TASKS), F.col(f"{goes}.task")).drop(goes), shape, name)
        merged = written.groupBy(F.col(shape["by"][1]).alias("into")).agg(F.count(F.lit(1)).alias("found"))
        wrong = into.join(merged, "into", "left").filter(F.coalesce("found", F.lit(0)) != F.col("rows")).count()
        if wrong:
            raise RuntimeError(f"{wrong} merged shards don't hold the rows of their runs")
        kept = todo.filter("more = 0").select(*LIVE)
        return self._commit(kept.union(into.select(F.lit(name), "into", "level", "rows", "bytes")), base, generations={name: shape})

    def read(self, version: int | None = None, place: str = "in") -> DataFrame:
        """All rows of a version, with the struct (shard, level, rows, bytes) of their shard under ``place`` or, if that is
        taken, the next free name, as the last column."""
        manifest = self.manifest(version)
        if not manifest["shards"]:
            raise ValueError("the store has no shards")
        shards = self.live(version).select("generation", "shard", F.struct("shard", "level", "rows", "bytes").alias("x"))
        return self._rows(manifest, shards, free_name(place, list(manifest["columns"])))

    def vacuum(self, older_than: float = 86_400) -> None:
        """Deletes the versions before the latest, and data, lists and claims that it doesn't name, if they are older than
        so many seconds: what another writer has written and not committed yet stays."""
        latest, before = self.manifest(), (time.time() - older_than) * 1000
        old = lambda f: f.getModificationTime() <= before
        for v in self.versions():
            at = self._path(f"{self.root}/manifests/v{v:010d}.json")
            if v < latest["version"] and old(self._files.getFileStatus(at)):
                self._files.delete(at, False)
        for f in [*self._names("lists"), *self._names("claims"), *(g for d in self._names("data") for g in self._files.listStatus(d.getPath()))]:
            name = f.getPath().getName()
            used = name.rpartition("=")[2] in latest["generations"] or (latest["list"] or "").endswith(f"/{name}") or name == f"v{latest['version']:010d}"
            if not used and old(f):
                self._files.delete(f.getPath(), True)


def sharded(docs: DataFrame, **options) -> DataFrame:
    """docs as the one arrival of a new store in the shared folder, compacted: its rows, as ``read`` returns them."""
    store = ShardStore(docs.sparkSession, shared_path(docs.sparkSession, "shards"), **options)
    store.append(docs)
    if store.compact()["shards"]:
        return store.read()
    return docs.limit(0).withColumn(free_name("in", docs.columns), F.struct(*[F.lit(0).cast(t).alias(c) for c, t in (("shard", "long"), ("level", "int"), ("rows", "long"), ("bytes", "long"))]))


#: Of 16 parts of the documents, those of each arrival.
ARRIVALS = ((0, 9), (9, 14), (14, 16))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, arrival, shard, level (merges), shard_rows, shard_bytes (of text).

    The documents arrive in three parts of unequal size; compaction runs after the first and after the last. Runs have a
    200th of the text, 8 KB at least and 4 MB at most, and shards 16 times as much."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    run_bytes = max(8 << 10, min(4 << 20, total // 200))
    store = ShardStore(spark, shared_path(spark, "shards"), run_bytes, 16 * run_bytes)
    part = hash32(F.concat(F.lit("arrival|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) % 16
    for k, (first, end) in enumerate(ARRIVALS):
        store.append(docs.filter((part >= first) & (part < end)))
        if k != 1:
            store.compact()
    arrival = sum(((part >= first).cast("int") for first, _ in ARRIVALS), F.lit(0))
    return store.read(place="in").select("doc_id", arrival.alias("arrival"), F.col("in.shard").alias("shard"), F.col("in.level").alias("level"), F.col("in.rows").alias("shard_rows"), F.col("in.bytes").alias("shard_bytes"))


def _compaction(name: str, shards: str) -> str:
    """SQL of two rounds of merges over a table (shard, bytes): tables that end with <name>2 (was, shard, more)."""
    rounds = ""
    for k in range(2):
        rounds += f"""
{name}n{k} AS (SELECT shard, sum(bytes) AS bytes FROM {name}{k} GROUP BY shard),
{name}t{k} AS (
  SELECT shard, shard // {LANE} AS lane, CASE WHEN bytes >= 16 * r * 3 // 4 THEN -1 ELSE (bytes >= r * 2)::INT + (bytes >= r * 8)::INT + (bytes >= r * 32)::INT END AS tier
  FROM {name}n{k}, sizes),
{name}o{k} AS (
  SELECT *, (row_number() OVER (PARTITION BY lane, tier ORDER BY shard) - 1) // 4 AS nth, count(*) OVER (PARTITION BY lane, tier) // 4 AS whole FROM {name}t{k}),
{name}m{k} AS (
  SELECT shard AS old, tier >= 0 AND nth < whole AS joins, CASE WHEN tier >= 0 AND nth < whole THEN min(shard) OVER (PARTITION BY lane, tier, nth) ELSE shard END AS now FROM {name}o{k}),
{name}{k + 1} AS (SELECT was, bytes, now AS shard, more + joins::INT AS more FROM {name}{k} JOIN {name}m{k} ON shard = old),"""
    return f"{name}0 AS (SELECT shard AS was, bytes, shard, 0 AS more FROM {shards}),{rounds}"


ORACLE = f"""
WITH sizes AS (SELECT greatest(8192, least(4194304, coalesce(sum(strlen(text)), 0) // 200))::BIGINT AS r FROM documents),
parts AS (
  SELECT doc_id, strlen(text) AS bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h,
         CASE WHEN p < 9 THEN 1 WHEN p < 14 THEN 2 ELSE 3 END AS arrival
  FROM (SELECT *, CAST('0x' || substr(md5('arrival|' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 16 AS p FROM documents)),
arrivals AS (
  SELECT arrival, runs, CAST(coalesce(sum(runs) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first
  FROM (SELECT a.arrival, greatest(1, (coalesce(sum(bytes), 0) + any_value(r) - 1) // any_value(r))::BIGINT AS runs FROM (VALUES (1), (2), (3)) AS a(arrival) CROSS JOIN sizes LEFT JOIN parts USING (arrival) GROUP BY a.arrival)),
d AS (SELECT doc_id, bytes, arrival, first + h % runs AS run FROM parts JOIN arrivals USING (arrival)),
s1 AS (SELECT run AS shard, sum(bytes) AS bytes FROM d WHERE arrival = 1 GROUP BY run),
{_compaction("a", "s1")}
after_one AS (
  SELECT was AS run, shard, max(more) OVER (PARTITION BY shard) AS level FROM a2
  UNION ALL SELECT DISTINCT run, run, 0 FROM d WHERE arrival > 1),
s2 AS (SELECT shard, sum(bytes) AS bytes FROM d JOIN after_one USING (run) GROUP BY shard),
{_compaction("b", "s2")}
after_two AS (SELECT o.run, b2.shard, max(CASE WHEN more > 0 THEN level + more ELSE level END) OVER (PARTITION BY b2.shard) AS level FROM after_one o JOIN b2 ON o.shard = b2.was)
SELECT doc_id, arrival, shard, CAST(level AS INTEGER) AS level, CAST(count(*) OVER (PARTITION BY shard) AS BIGINT) AS shard_rows, CAST(sum(bytes) OVER (PARTITION BY shard) AS BIGINT) AS shard_bytes
FROM d JOIN after_two USING (run)
"""

QUERIES = {"op1_sharding": op1_sharding}
ORACLES = {"op1_sharding": ORACLE}
