"""An append-only store of deduplicated shards: the one stateful operator, fed by batches or by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import words
from tessera.operators import similarity as sm
from tessera.sources.tables import cut

MANIFEST = "shard_id string, lane string, held_out boolean, reserve boolean, offered long, kept long, dropped_within long, dropped_across long, tokens long"


class ShardStore:
    """Folders under path: documents, signatures (one per kept document) and manifest, each partitioned by shard. A shard's
    manifest row is written last and is its commit: what has none is never read, and adding it again overwrites it."""

    def __init__(self, spark: SparkSession, path: str, within: float | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.within = sm.threshold() if within is None else within
        #: A signature's estimate must exceed the threshold by its standard error, as full sets aren't stored.
        self.across = self.within + sm.PERMUTATIONS**-0.5

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/*") if self._exists("manifest") else self.spark.createDataFrame([], MANIFEST)

    def _committed(self, name: str) -> DataFrame:
        ids = [r["shard_id"] for r in self.manifest().where("kept > 0").select("shard_id").collect()]  # one row a shard
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/shard_id={i}" for i in ids]) if ids else None

    def documents(self, held_out: bool | None = None, reserve: bool | None = None) -> DataFrame | None:
        """Kept documents, of shards with these marks where given; None while the store is empty."""
        docs, m = self._committed("documents"), self.manifest()
        for name, want in (("held_out", held_out), ("reserve", reserve)):
            m = m if want is None else m.where(F.col(name) == want)
        return docs if docs is None else docs.join(m.select("shard_id"), "shard_id", "left_semi")

    def trainable(self) -> DataFrame | None:
        return self.documents(held_out=False, reserve=False)

    def totals(self) -> DataFrame:
        """(lane, tokens) without held-out shards."""
        return self.manifest().where("not held_out").groupBy("lane").agg(F.sum("tokens").alias("tokens"))

    def add(self, docs: DataFrame, shard_id: str, lane: str, held_out: bool = False, reserve: bool = False) -> dict:
        """docs(doc_id unique, text), in order of doc_id. Drops documents that earlier shards hold (signatures' estimate),
        then greedily those that an earlier one of this shard holds (full sets), and commits the rest. Null text counts as
        empty. A shard that is committed already is left alone and its report returned."""
        if done := self.manifest().where(F.col("shard_id") == shard_id).collect():
            return done[0].asDict()
        given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        sets = cut(given.select("doc_id", sm.shingles(F.col("text")).alias("set")))
        sets = cut(sets.select("*", sm.signature(F.col("set")).alias("sig")))
        known = self._committed("signatures")
        fresh, across = sets, 0
        if known is not None:
            new = sets.select("sig").distinct().select("sig", F.explode(sm.band_keys(F.col("sig"))).alias("key"))
            old = known.select(F.col("sig").alias("old"), F.explode("keys").alias("key"))
            like = new.join(old, (new["key"] == old["key"]) & (sm.estimate(F.col("sig"), F.col("old")) >= self.across), "left_semi").select("sig").distinct()
            fresh = cut(sets.join(like, "sig", "left_anti"))
            across = sets.count() - fresh.count()
        gone = cut(sm.greedy_dropped(fresh.select(F.col("doc_id").alias("ord"), "set"), self.within))
        kept = cut(fresh.join(gone, fresh["doc_id"] == gone["ord"], "left_anti").select("doc_id", "sig"))
        stays = given.join(kept.select("doc_id"), "doc_id", "left_semi").select("*", F.size(words(F.col("text"))).cast("long").alias("n_tokens"))
        n = kept.count()
        if n:
            stays.write.mode("overwrite").parquet(f"{self.path}/documents/shard_id={shard_id}")
            kept.select("doc_id", "sig", sm.band_keys(F.col("sig")).alias("keys")).write.mode("overwrite").parquet(f"{self.path}/signatures/shard_id={shard_id}")
        tokens = self.spark.read.parquet(f"{self.path}/documents/shard_id={shard_id}").agg(F.sum("n_tokens")).first()[0] if n else 0
        report = (shard_id, lane, held_out, reserve, n + gone.count() + across, n, gone.count(), across, tokens)
        row = self.spark.createDataFrame([report], MANIFEST)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{shard_id}")
        return row.first().asDict()

    def ingest(self, stream: DataFrame, prefix: str, lane: str, checkpoint: str, **trigger) -> StreamingQuery:
        """Adds each micro-batch of a stream as one shard; a batch that is replayed after a failure is committed once."""
        sink = stream.writeStream.foreachBatch(lambda batch, i: self.add(batch, f"{prefix}-{i:08d}", lane) and None)
        return sink.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
