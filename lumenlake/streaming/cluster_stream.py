"""Clusters of a stream of hashes, without a rebuild: a batch looks only for the partners of its new hashes.

Three tables of deltas grow with the batches: the changes of assets, an index of the chunk keys of all hashes seen, and
the near pairs found. A new hash is looked up in the index once, when it first comes; pairs of hashes that no asset has
any more stay and come back with their assets. Counts and representatives follow from the changes by one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenlake.constants import BUCKET_DIGITS, NEAR_DISTANCE
from lumenlake.functions.hashing import bit_distance, hash_bits
from lumenlake.operators.clusters import ChunkKeys, exact_clusters, hash_groups, similar_clusters, visual_clusters
from lumenlake.operators.merges import latest_by_key
from lumenlake.sources.tables import write_batch

#: What a stream brings: an asset with its fresh hashes, or one that is gone. The largest (batch, seq) of an id counts.
CHANGES = "id string, content_hash string, visual_hash string, gone boolean, seq bigint"
_INDEX = "hash string, bits bigint, bucket string, chunk int, tag int, value bigint, batch_id bigint"
_PAIRS = "hash_a string, hash_b string, distance int, batch_id bigint"
_KEY = ["bucket", "chunk", "tag", "value"]


def _before(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """The deltas of earlier batches; a batch that is replayed doesn't see its own."""
    from lumenlake.sources.tables import _filesystem

    files, folder = _filesystem(spark, path)
    if not files.exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path).where(F.col("batch_id") < batch_id)


def _opened(hashes: DataFrame, keys) -> DataFrame:  # noqa: ANN001
    return hashes.withColumn("_k", F.explode(keys)).select("hash", "bits", "bucket", "_k.chunk", "_k.tag", "_k.value")


def commit_batch(batch: DataFrame, path: str, batch_id: int, digits: int = BUCKET_DIGITS, max_distance: int = NEAR_DISTANCE) -> None:
    """Store a batch of changes, the index entries of its new hashes, and the near pairs these make.

    Replaying a batch replaces what it wrote. A key holds only hashes that agree in a whole chunk up to a flip or two,
    never a whole bucket.
    """
    spark = batch.sparkSession
    write_batch(batch, f"{path}/changes", batch_id)
    stored = spark.read.parquet(f"{path}/changes/batch_id={batch_id}")
    known = _before(spark, f"{path}/index", _INDEX, batch_id)
    hashes = stored.where(~F.col("gone") & F.col("visual_hash").isNotNull()).select(F.col("visual_hash").alias("hash")).distinct()
    # every hash has one entry of the first chunk under its own value
    fresh = hashes.join(known.where("chunk = 0 and tag = 0").select("hash").distinct(), "hash", "left_anti")
    fresh = fresh.withColumns({"bits": hash_bits(F.col("hash")), "bucket": F.substring("hash", 1, digits)})
    plan = ChunkKeys(digits, max_distance)
    write_batch(_opened(fresh, plan.second(F.col("bits"))), f"{path}/index", batch_id)
    mine = spark.read.parquet(f"{path}/index/batch_id={batch_id}")
    new = mine.where("chunk = 0 and tag = 0").select("hash", "bits", "bucket").distinct()
    probes = _opened(new, plan.first(F.col("bits")))
    columns = ["hash", "bits", *_KEY]
    old = known.select(*columns).withColumn("_old", F.lit(True))
    index = old.unionByName(mine.select(*columns).withColumn("_old", F.lit(False)))
    index = index.withColumnsRenamed({"hash": "other", "bits": "other_bits"})
    distance = bit_distance(F.col("bits"), F.col("other_bits"))
    once = F.col("_old") | (F.col("hash") < F.col("other"))
    near = (F.col("hash") != F.col("other")) & once & (distance <= max_distance)
    met = probes.join(index, _KEY).where(near & plan.counted(F.col("bits").bitwiseXOR(F.col("other_bits")), F.col("chunk")))
    pairs = met.select(
        F.least("hash", "other").alias("hash_a"), F.greatest("hash", "other").alias("hash_b"), distance.alias("distance")
    )
    write_batch(pairs, f"{path}/pairs", batch_id)


def start_clusters(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start keeping the clusters of a stream of ``CHANGES`` below ``path``."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, batch_id: commit_batch(batch, path, batch_id))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current_members(spark: SparkSession, path: str) -> DataFrame:
    """(id, content_hash, visual_hash) of the assets that are there now."""
    changes = spark.read.schema(f"{CHANGES}, batch_id bigint").option("basePath", f"{path}/changes").parquet(f"{path}/changes")
    ordered = changes.withColumn("seq", F.struct("batch_id", "seq")).drop("batch_id")
    return latest_by_key(ordered, "id", "seq").where(~F.col("gone")).select("id", "content_hash", "visual_hash")


def current_pairs(spark: SparkSession, path: str, groups: DataFrame) -> DataFrame:
    """The near pairs of hashes that assets have now, in the form of ``near_pairs``; no search, two joins by hash."""
    found = spark.read.schema(_PAIRS).option("basePath", f"{path}/pairs").parquet(f"{path}/pairs").drop("batch_id")

    def side(name: str) -> DataFrame:
        return groups.select(
            F.col("visual_hash").alias(f"hash_{name}"),
            F.col("member_count").alias(f"members_{name}"),
            F.col("representative_id").alias(f"first_{name}"),
        )

    joined = found.join(side("a"), "hash_a").join(side("b"), "hash_b")
    least = F.least("first_a", "first_b").alias("representative_id")
    return joined.select("hash_a", "hash_b", "distance", "members_a", "members_b", least)


def current_clusters(spark: SparkSession, path: str) -> DataFrame:
    """All clusters of the three kinds as of the last batch, in the form of ``rebuild_clusters``."""
    members = current_members(spark, path)
    columns = ["cluster_id", "kind", "representative_id", "member_count"]
    similar = similar_clusters(current_pairs(spark, path, hash_groups(members, "visual_hash")))
    return exact_clusters(members).select(*columns).unionByName(visual_clusters(members).select(*columns)).unionByName(similar)
