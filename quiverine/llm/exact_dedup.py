"""Exact deduplication through an extendible-hash index on shared files.

Built of DataFrame operations only. Every text's key is 60 bits of a digest of its
normalised form. The directory maps the key's leading bits to buckets: a bucket that
holds more keys than it may is split, and wherever that needs one more bit than any
bucket had, the directory doubles. Keys go through the directory to their buckets, and
buckets to tasks that own ranges of (bucket, key): an owner forms the groups of its keys
and chains what collides, one entry for each different text of a key. What the owners
write, files in order of (bucket, key), is the index; a second folder holds the
directory. Each document is then looked up in it, again through the directory.

Before keys move, each task counts its own equal ones, so that a text that a third of
all rows have arrives as a few rows. Texts move only where several rows share a key, and
equal ones of a task as one: their bytes are compared where they meet. Which texts these
are is told by a set of bits of bounded size, which lets all through where it is full.

Defined results: a null text counts as empty, and white space is one space wherever it
stands, also at the ends; the row with the smallest id stays (null ids last); rows
that also repeat the id share a keep_id, and one of them stays; an empty table gives
no rows; further columns are not read, or are kept as they are (``keep_first``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bits_of, free_name, hot_share, sifted, split_count, text_of, unmatched

#: Bits of a key that the directory can use at most; so it has 65,536 entries at most.
MAX_DEPTH = 16


def normalised(text: str | Column) -> Column:
    """The text with each run of white space replaced by one space."""
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def key_of(sha: Column, bits: int = 60) -> Column:
    """The leading bits of a hex digest as a long; fewer ``bits`` make keys collide (for tests)."""
    wide = F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")  # 60 bits: always positive
    return wide if bits >= 60 else F.shiftrightunsigned(wide, 60 - bits) * F.lit(1 << (60 - bits))


def prefix_of(key: Column) -> Column:
    """The key's MAX_DEPTH leading bits."""
    return F.shiftrightunsigned(key, 60 - MAX_DEPTH).cast("int")


def directory(keys: DataFrame, capacity: int) -> DataFrame:
    """For each prefix of MAX_DEPTH bits under which there are keys: the bucket it leads to and that bucket's depth.

    ``keys`` has a row or a few for each key. A bucket of depth d holds all keys that share
    d leading bits; it is split until it holds ``capacity`` rows at most, or no bits are
    left. Depths are found for all prefixes at once, from counts of every prefix's nodes:
    131,071 nodes at most, whatever the table's size.
    """
    counts = keys.groupBy(prefix_of(F.col("key")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    by_depth = counts.select("n", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))).alias("depth"), "prefix").withColumn("node", F.expr(f"shiftright(prefix, {MAX_DEPTH} - depth)"))
    held = by_depth.groupBy("depth", "node").agg((F.sum("n") > capacity).alias("over")).withColumn("over", F.col("over") & (F.col("depth") < MAX_DEPTH))
    # A bucket is what fits and whose parent doesn't; the root has no parent.
    split = held.filter("over").select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    leaves = held.filter("not over").withColumn("parent", F.shiftright("node", 1)).join(split, ["depth", "parent"], "left_semi").select("depth", "node")
    leaves = leaves.unionByName(held.filter("not over and depth = 0").select("depth", "node"))
    first = F.expr(f"shiftleft(node, {MAX_DEPTH} - depth)")
    last = F.expr(f"shiftleft(node + 1, {MAX_DEPTH} - depth) - 1")
    return leaves.select(F.explode(F.sequence(first, last)).alias("prefix"), "depth", first.alias("bucket"))


def routed(keys: DataFrame, directory_: DataFrame, how: str = "inner") -> DataFrame:
    """The keys with the buckets that the directory leads them to: 65,536 short rows at most are broadcast."""
    side = F.broadcast(directory_.select("prefix", "bucket"))
    return keys.withColumn("prefix", prefix_of(F.col("key"))).join(side, "prefix", how).drop("prefix")


@dataclass
class ExtendibleIndex:
    """An index on shared files: ``entries`` (bucket, key, chain, sha, keep_id, keep_row, group_size, texts) and ``directory``.

    ``chain`` numbers the different texts of a key, and ``texts`` counts them.
    """

    entries: DataFrame
    directory: DataFrame

    def lookup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Each document's id with the keep_id of the equal indexed text, null where there is none."""
        sha = digest(normalised(text_col))
        asked = docs.select(F.col(id_col).alias("doc_id"), sha.alias("sha")).withColumn("key", key_of(F.col("sha")))
        entries = self.entries.select("bucket", "key", "sha", "keep_id")
        return routed(asked, self.directory, "left").join(entries, ["bucket", "key", "sha"], "left").select("doc_id", "keep_id")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ExtendibleIndex:
        return ExtendibleIndex(spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/directory"))


def _smallest() -> Column:
    """Of a group's rows, the one with the smallest id; null ids come last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row")))


def build(docs: DataFrame, scratch: Scratch, capacity: int = 1 << 16, bits: int = 60, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, ExtendibleIndex]:
    """The documents' keys (doc_id, row, key, sha) and the index over their texts."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    keyed = texts.select("doc_id", digest(F.col("norm")).alias("sha")).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), key_of(F.col("sha"), bits).alias("key"), "sha"
    )
    keys = scratch.table(keyed, "keys")
    # The row's upper bits tell the task that read it: a key has as many rows here as tasks have it.
    by_task = keys.groupBy("key", "sha", F.shiftright("row", 33).alias("task"))
    combined = scratch.table(by_task.agg(F.count(F.lit(1)).alias("copies"), _smallest().alias("first")), "combined")
    dir_table = scratch.table(directory(combined, capacity), "directory")
    # Each task owns a range of (bucket, key): the groups and chains of its keys are formed without another move.
    owned = routed(combined, dir_table).repartitionByRange(split_count(spark), "bucket", "key")
    groups = owned.groupBy("bucket", "key", "sha").agg(F.sum("copies").alias("group_size"), F.min("first").alias("first"))
    of_key = Window.partitionBy("bucket", "key")
    entries = scratch.table(
        groups.select(
            "bucket", "key", F.row_number().over(of_key.orderBy("sha")).alias("chain"), "sha", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"),
            "group_size", F.count(F.lit(1)).over(of_key).alias("texts"),
        ).sortWithinPartitions("bucket", "key", "sha"),
        "entries",
    )
    shared = scratch.table(bits_of(F.col("key"), entries.filter("group_size > 1 or texts > 1")), "shared-bits")
    again = sifted(texts.select(key_of(digest(F.col("norm")), bits).alias("key"), "norm"), F.col("key"), shared, True)
    met = again.groupBy("key", "norm").agg(F.count(F.lit(1)).alias("copies"))
    chains = scratch.table(met.select("key", digest(F.col("norm")).alias("sha"), "copies"), "chains")
    # Where bytes differ, so do digests; two texts with one digest would show here.
    if chains.groupBy("key", "sha").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").limit(1).count():
        raise ValueError("different texts share a SHA-256 digest")
    scratch.drop("combined", "chains", "shared-bits")
    return keys, ExtendibleIndex(entries, dir_table)


def exact_dedup(docs: DataFrame, capacity: int = 1 << 16, bits: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    keys, index = build(docs, Scratch(spark, "exact-dedup"), capacity, bits, id_col, text_col)
    own = ["bucket", "key", "sha"]
    entries = index.entries.select(*own, "keep_id", "keep_row", "group_size")
    # Large groups are looked up: a broadcast of few rows at any size.
    share, total = hot_share(spark), keys.count()
    hot = entries.filter(F.col("group_size") * share >= max(total, share)).filter("group_size > 1")
    asked = routed(keys, index.directory)
    with_hot = asked.join(F.broadcast(hot.withColumn("hot", F.lit(True))), own, "left")
    result = lambda d: d.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
    cold = with_hot.filter("hot is null").select("doc_id", "row", *own).join(entries, own)
    return result(with_hot.filter("hot")).unionByName(result(cold))


def keep_first(docs: DataFrame, capacity: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    The dropped documents' (id, digest) pairs grow with the input, so texts move to where
    their pairs are, at any size; but only those whose ids may be among the dropped ones.
    Rows that repeat both id and text are dealt with apart, as there are none in a table
    with unique ids.
    """
    marked = exact_dedup(docs, capacity, id_col=id_col, text_col=text_col)
    scratch = Scratch(docs.sparkSession, "exact-keep")
    sha, ident = free_name(docs, "text_sha"), F.col(id_col)
    lost = scratch.table(marked.filter("not kept").select(F.col("doc_id").alias("lost_id"), F.col("text_sha256").alias("lost_sha"), (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("repeat")), "lost")
    ids = scratch.table(bits_of(F.col("lost_id"), lost), "lost-bits")
    with_sha = sifted(docs, ident, ids, True).withColumn(sha, digest(normalised(text_col)))
    on = lambda side: ident.eqNullSafe(side["lost_id"]) & (with_sha[sha] == side["lost_sha"])
    copies = lost.filter("not repeat").select("lost_id", "lost_sha").distinct()
    stay = unmatched(with_sha, copies, on(copies))
    repeats = lost.filter("repeat").select("lost_id", "lost_sha").distinct()
    if repeats.limit(1).count():
        twice = stay.join(repeats, on(repeats), "left_semi").dropDuplicates([id_col, sha])
        stay = unmatched(stay, repeats, on(repeats)).unionByName(twice)
    return sifted(docs, ident, ids, False).unionByName(stay.drop(sha))
