"""Exact dedup (op2): stateful streaming deduplication over disk-backed keyed state.

Each text's digest is the key of a streaming aggregation without watermark, so state never expires. The state
is kept by the RocksDB provider and holds, for a digest, the stable identifier and the content locator (file and
row) of the row that stays, and the number of rows. A digest that is hit again is only a candidate: the full bytes
at both locators are compared, and a digest whose rows differ is grouped anew by its full bytes.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import FILES_A_CORE, Scratch, with_locator

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A digest with more than 1/HEAVY of all rows is heavy: at most HEAVY of them exist, so their list can be broadcast.
HEAVY, SALTS = 1000, 64


@contextmanager
def disk_state(spark: SparkSession):
    """RocksDB keeps streaming state on disk, with one bounded cache for all stores of an executor."""
    own = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store reserves some MB of disk
        # a batch adds one file of changes to a store instead of a snapshot; the file system has checksums of its own
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text):
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def keyed_state(spark: SparkSession, keys: DataFrame, scratch: Scratch, files_per_batch: int) -> DataFrame:
    """Runs the stream over `keys` (digest, id, __loc_file, __loc_row): digest, keep (id, __loc_file, __loc_row), n."""
    updates = scratch.path("updates")
    files = FILES_A_CORE * spark.sparkContext.defaultParallelism  # however many state stores there are
    keys.write.option("compression", "zstd").parquet(scratch.path("keys"))
    with disk_state(spark):
        query = (
            spark.readStream.schema(keys.schema)
            .option("maxFilesPerTrigger", files_per_batch)
            .parquet(scratch.path("keys"))
            .groupBy("digest")
            .agg(F.max(F.struct("id", "__loc_file", "__loc_row")).alias("keep"), F.count(F.lit(1)).alias("n"))
            .writeStream.outputMode("update")
            .option("checkpointLocation", scratch.path("state"))
            .foreachBatch(lambda df, k: df.coalesce(files).write.mode("overwrite").parquet(f"{updates}/batch={k}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    if spark.read.schema(keys.schema).parquet(scratch.path("keys")).isEmpty():
        return spark.createDataFrame([], "digest binary, keep struct<id:bigint,__loc_file:string,__loc_row:bigint>, n bigint")
    # the state of a digest only grows, so its last update is its largest
    last = spark.read.parquet(updates).groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"))
    return scratch.few(last, "final")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None, files_per_batch: int = 1000) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are equal after lower-casing A-Z; null counts as empty. Of equal rows the
    one with the largest id stays (a null id is smaller than any other; rows that share the largest id: the one
    stored last). Empty table: empty result. Other columns are ignored.
    digest: a function from the normalised text to a key, SHA-256 unless given; a weak one costs time only.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    placed = with_locator(docs, scratch, [id_col, text_col])
    return decide(placed, scratch, id_col, text_col, digest, files_per_batch).drop("__loc_file", "__loc_row")


def decide(placed: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", digest=None, files_per_batch: int = 1000) -> DataFrame:
    """`exact_dedup` of rows with their places, which it returns as well."""
    spark = placed.sparkSession
    strong = digest is None
    digest = digest or (lambda t: F.unhex(F.sha2(F.encode(t, "UTF-8"), 256)))
    rows = placed.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm"), "__loc_file", "__loc_row")
    keyed = rows.withColumn("digest", digest(F.col("norm")))
    final = keyed_state(spark, keyed.select("digest", "id", "__loc_file", "__loc_row"), scratch, files_per_batch)
    total = final.agg(F.sum("n")).first()[0] or 0
    multi = final.filter("n > 1")
    heavy = F.broadcast(multi.filter(F.col("n") * HEAVY > total).select("digest", F.lit(SALTS).alias("salts")))

    def salted(df, salt):
        """A heavy digest's rows are dealt over SALTS tasks."""
        return df.join(heavy, "digest", "left").withColumn("salt", salt(F.coalesce("salts", F.lit(1)))).drop("salts")

    one = lambda n: F.pmod(F.xxhash64("__loc_file", "__loc_row"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    hits = salted(keyed, one).join(salted(multi, each).hint("shuffle_hash"), ["digest", "salt"])
    hits = scratch.table(hits.withColumn("winner", (F.col("__loc_file") == F.col("keep.__loc_file")) & (F.col("__loc_row") == F.col("keep.__loc_row"))), "hits")
    winners = salted(hits.filter("winner").select("digest", F.col("norm").alias("bytes_there")), each)
    differ = hits.filter("NOT winner").join(winners.hint("shuffle_hash"), ["digest", "salt"]).filter("norm <> bytes_there").select("digest").distinct()
    differ = scratch.table(differ, "differ")
    scratch.drop("updates", "state")

    keys = spark.read.schema(keyed.select("digest", "id", "__loc_file", "__loc_row").schema).parquet(scratch.path("keys"))
    if differ.isEmpty():
        scratch.drop("hits")
        true = keys.join(final, "digest")
    else:  # digests that collide: group by full bytes
        wrong = hits.join(differ, "digest", "left_semi").select("digest", "norm", "id", "__loc_file", "__loc_row")
        again = wrong.groupBy("digest", "norm").agg(F.max(F.struct("id", "__loc_file", "__loc_row")).alias("keep"), F.count(F.lit(1)).alias("n"))
        fixed = wrong.join(again, ["digest", "norm"]).select("digest", "id", "__loc_file", "__loc_row", "keep", "n")
        true = keys.join(differ, "digest", "left_anti").join(final, "digest").unionByName(fixed)
    if strong:
        true = true.withColumn("sha", F.lower(F.hex("digest")))
    else:
        sha = rows.select("__loc_file", "__loc_row", F.sha2(F.encode("norm", "UTF-8"), 256).alias("sha"))
        true = true.join(sha, ["__loc_file", "__loc_row"])
    return true.select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("__loc_file") == F.col("keep.__loc_file")) & (F.col("__loc_row") == F.col("keep.__loc_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "__loc_file",
        "__loc_row",
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: the pipeline's stage."""
    scratch = Scratch(docs.sparkSession, "exact")
    placed = with_locator(docs, scratch, docs.columns)
    keep = decide(placed, scratch).filter("kept").select("__loc_file", "__loc_row")
    return placed.join(keep, ["__loc_file", "__loc_row"], "left_semi").select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: one row per row of `documents`."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP2_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g ON n.text_sha256 = g.text_sha256
"""
