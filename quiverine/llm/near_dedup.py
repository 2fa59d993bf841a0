"""Near-duplicate components by one-permutation MinHash, banded buckets and star-shaped edges.

A text's shingles are hashed once; the hash's high bits choose one of the signature's
bins, and each bin keeps its smallest hash. Empty bins borrow from a full bin that a
hash of the bin and the attempt chooses, which keeps the estimate unbiased (optimal
densification). Bands of the signature are buckets. Texts with one and the same set of
shingles are one class from the start, so that copies cost nothing from here on.

In a bucket, edges between one class, the hub, and the others become candidates: a
star, not all pairs. The hub is the class that meets most others over all its buckets:
of many copies of a text, each with changes of its own, that is the text itself. Each
candidate is confirmed on the full sets, and components are formed. A bucket within one
component is done. Of another one, all classes outside of the hub's component stay, and
of those inside the ones that the distances to the hub leave room for: Jaccard distance
is a metric, so two classes whose distances to a hub differ by more than the limit can't
be linked. What is left, a few classes as a rule, meets in cells with its full sets, and
one link between any two components that have some is kept. Where much is left, as of
texts that share a passage but not enough for a link, the classes are dealt anew by bands
of sketches, signatures of more bins, which need far more in common than a band of the
signature; what shares such a band meets in cells. So there are two passes at any size.
Cells are bounded in classes and in shingles, so that none is left out and no task holds
a bucket.

What can be lost: a pair at the threshold shares no band with a chance under 1e-6, and no
band of the sketches with a chance under 1e-6; more similar pairs are lost less often.
Words and shingles are 64-bit hashes.

Components come from alternating large-star and small-star steps on tables; nothing is
gathered on the driver but counts.

Defined results: a text without words (or null) has no shingles and is linked with
nothing; one with fewer words than a shingle has a single shingle of all of them; rows
that repeat an id are one document with the texts of all of them; rows with a null id
take no part, and stay; an empty table gives no rows; further columns are not read, or
are kept as they are (``keep_first``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, batches, bits_of, free_name, hot_share, settle, ship, sifted, text_of, without_ids
from .shingles import mixed, shingle_sets

#: Bands of a signature.
BANDS = 32
#: The chance of missing a pair at the threshold is this at most.
MISS = 1e-6
#: What is left of a bucket meets in cells at once if it makes so many pairs of different components at most.
REST_PAIRS = 1 << 26
#: Classes, and shingles of theirs, that meet as many others in one cell.
CELL, CELL_SHINGLES = 4096, 1 << 21
#: Bins of the sketches, each of 8 bits.
SKETCH = 1024
#: A hub's edges are dealt out in groups of about so many, each with its own copy of the hub's set.
EDGES_AT_ONCE = 512


@dataclass(frozen=True)
class Near:
    """What counts as near: shingles of ``width`` words, ``percent`` of the union in common."""

    width: int = 5
    percent: int = 80

    @property
    def rows(self) -> int:
        """Bins in a band: as many as the chance of a miss allows."""
        return self._band(lambda r: BANDS, 16)

    @property
    def sketch_rows(self) -> int:
        """Bins in a band of a sketch, likewise."""
        return self._band(lambda r: SKETCH // r, 64)

    def _band(self, bands: Callable[[int], int], most: int) -> int:
        t, r = self.percent / 100, 1
        while r < most and (1 - t ** (r + 1)) ** bands(r + 1) <= MISS:
            r += 1
        return r

    @property
    def bins(self) -> int:
        return BANDS * self.rows

    @property
    def least(self) -> int:
        """The smallest set that can be linked with a different one."""
        return -(-self.percent // (100 - self.percent)) if self.percent < 100 else 1 << 60


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def signatures(sets: np.ndarray, sizes: np.ndarray, bins: int) -> np.ndarray:
    """The densified one-permutation signature of each set (sorted distinct hashes, one set after another; none empty)."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    bin_of = ((sets >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(sets), bool)
    first[1:] = (bin_of[1:] != bin_of[:-1]) | (owner[1:] != owner[:-1])
    out, full = np.zeros((n, bins), np.uint64), np.zeros((n, bins), bool)
    out[owner[first], bin_of[first]] = sets[first]
    full[owner[first], bin_of[first]] = True
    row, at = np.nonzero(~full)
    attempt = np.uint64(0)
    while len(row):
        attempt += np.uint64(1)
        asked = (mixed(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + attempt) % np.uint64(bins)).astype(np.int64)
        hit = full[row, asked]
        out[row[hit], at[hit]] = out[row[hit], asked[hit]]
        row, at = row[~hit], at[~hit]
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each band of each signature; equal bands at different places differ."""
    n = len(signature)
    parts = signature.reshape(n, -1, rows)
    acc = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), (n, parts.shape[1])).copy()
    for j in range(rows):
        acc = mixed(acc * np.uint64(3) + parts[:, :, j] + np.uint64(1))
    return acc.view(np.int64)


def set_keys(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a set."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(sets ^ np.uint64(salt)), dtype=np.uint64)])
        ends = np.cumsum(sizes)
        out.append((total[ends] - total[ends - sizes]).view(np.int64))
    return out[0], out[1]


def signed(docs: DataFrame, near: Near) -> DataFrame:
    """One row per document: doc_id, n_shingles, key_a, key_b, bands (null where the set can't be linked with another)."""

    def sign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text", 512 << 10):
            sets, sizes = shingle_sets(_texts(batch), near.width)
            a, b = set_keys(sets, sizes)
            long = sizes >= near.least
            marks: list[np.ndarray | None] = [None] * len(sizes)
            if long.any():
                found = bands(signatures(sets[np.repeat(long, sizes)], sizes[long], near.bins), near.rows)
                for i, mark in zip(np.flatnonzero(long).tolist(), found, strict=True):
                    marks[i] = mark
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(a), pa.array(b), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "key_a", "key_b", "bands"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>")


def full_sets(docs: DataFrame, near: Near) -> DataFrame:
    """The documents' sets of shingles, ascending, and their sketches, signatures of 8 bits for each bin: doc_id, shingles, sketch."""

    def sets_of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text", 512 << 10):
            sets, sizes = shingle_sets(_texts(batch), near.width)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            sketches: list[bytes | None] = [None] * len(sizes)
            full = np.flatnonzero(sizes)
            if len(full):
                found = mixed(signatures(sets, sizes[full], SKETCH)).astype(np.uint8)
                for i, sketch in zip(full.tolist(), found, strict=True):
                    sketches[i] = sketch.tobytes()
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sets.view(np.int64))), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shingles", "sketch"])

    return docs.mapInArrow(sets_of, "doc_id long, shingles array<long>, sketch binary")


def _links_of(cells: DataFrame, near: Near) -> DataFrame:
    """Of rows (cell, side, member, component, shingles) that come cell by cell, links (hub, member) between components.

    Rows of one side don't meet each other where it is 0 or more.
    """

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in rows:
            if not batch.num_rows:
                continue
            held.append(batch)
            if batch.column("cell")[-1] != held[0].column("cell")[0]:
                # The last cell may go on in the next batch.
                whole = pa.Table.from_batches(held).combine_chunks()
                last = int(np.flatnonzero(np.diff(whole["cell"].to_numpy()))[-1]) + 1
                yield _spanning(whole.slice(0, last), near)
                held = whole.slice(last).to_batches()
        if held:
            yield _spanning(pa.Table.from_batches(held).combine_chunks(), near)
        settle()

    return cells.select("cell", "side", "member", "component", "shingles").mapInArrow(work, "hub long, member long")


def _spanning(rows: pa.Table, near: Near) -> pa.RecordBatch:
    """Links that connect what any two rows of a cell connect: one for each two components that have some, at most."""
    cell, side, member, component = (rows[c].to_numpy() for c in ("cell", "side", "member", "component"))
    lists = rows["shingles"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    ends = np.cumsum(sizes)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(rows)]]).tolist()
    found: list[tuple[int, int]] = []
    for start, end in zip(edges, edges[1:], strict=False):
        names, label = np.unique(component[start:end], return_inverse=True)
        if len(names) < 2:
            continue
        # The classes outside of the largest component ask, of one side where there are two.
        asks = np.flatnonzero(label != np.bincount(label).argmax() if (side[start:end] < 0).any() else side[start:end] == side[start:end].min())
        size = sizes[start:end]
        _, own = np.unique(flat[ends[start] - sizes[start] : ends[end - 1]], return_inverse=True)
        before = ends[start:end] - size - (ends[start] - sizes[start])
        full = np.flatnonzero(size)
        marked = np.zeros(int(own.max(initial=-1)) + 1, np.uint8)
        for i in asks.tolist():
            # No set is linked with one that is so much larger; sides of 0 or more don't meet themselves.
            fit = (label[full] != label[i]) & (np.minimum(size[full], size[i]) * 100 >= np.maximum(size[full], size[i]) * near.percent)
            if side[start + i] >= 0:
                fit &= side[start:end][full] != side[start + i]
            if not fit.any():
                continue
            at = own[before[i] : before[i] + size[i]]
            marked[at] = 1
            shared = np.zeros(len(size), np.int64)
            shared[full] = np.add.reduceat(marked[own], before[full], dtype=np.int64)
            marked[at] = 0
            others = full[fit]
            linked = others[shared[others] * 100 >= (size[others] + size[i] - shared[others]) * near.percent]
            for j in linked[np.unique(label[linked], return_index=True)[1]].tolist():
                found.append((int(member[start + i]), int(member[start + j])))
                label[label == label[j]] = label[i]
    low, high = ([f(pair) for pair in found] for f in (min, max))
    return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["hub", "member"])


def _cells(rows: DataFrame, sizes: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (bucket, member, component) dealt to cells of bounded size, in which all pairs of a bucket meet that count.

    Classes of the largest component, the major one of ``sizes`` (as of ``_several``), needn't meet each other: they
    are copied once for each cell's worth of the others, and the others once for each of the bucket. A bucket that
    is small is one cell.
    """
    full = lambda n, shingles: F.greatest(F.ceil(n / CELL), F.ceil(shingles / CELL_SHINGLES), F.lit(1)).cast("int")
    minors, majors = full(F.col("all") - F.col("most"), F.col("shingles") - F.col("most_shingles")), full(F.col("most"), F.col("most_shingles"))
    shape = sizes.select("bucket", "major", minors.alias("minors"), majors.alias("majors"))
    dealt = rows.join(shape, "bucket").withColumn("minor", F.col("component") != F.col("major"))
    number = lambda sides: F.pmod(F.xxhash64("member"), F.col(sides)).cast("int")
    dealt = dealt.withColumn("own", F.when(F.col("minor"), number("minors")).otherwise(number("majors")))
    each = lambda sides, of: F.transform(F.sequence(F.lit(0), F.col(sides) - 1), of)
    place = lambda kind, x, y, side: F.struct(F.xxhash64("bucket", F.lit(kind), x, y).alias("cell"), side.cast("int").alias("side"))
    # Minor classes meet each other in cells of one kind, and major ones in cells of another.
    with_minors = each("minors", lambda y: place(0, F.least("own", y), F.greatest("own", y), F.when(F.col("own") == y, -1).otherwise(F.col("own"))))
    with_majors = each("majors", lambda z: place(1, F.col("own"), z, F.lit(0)))
    of_major = each("minors", lambda x: place(1, x, F.col("own"), F.lit(1)))
    alone = (F.col("minors") == 1) & (F.col("majors") == 1)
    cells = F.when(alone, F.array(place(0, F.lit(0), F.lit(0), F.lit(-1)))).when(F.col("minor"), F.concat(with_minors, with_majors)).otherwise(of_major)
    placed = dealt.select(F.explode(cells).alias("at"), "member", "component").select("at.cell", "at.side", "member", "component")
    return placed.join(sets.select(F.col("doc_id").alias("member"), "shingles"), "member").repartition("cell").sortWithinPartitions("cell", "member")


def _by_sketch(rows: DataFrame, near: Near) -> DataFrame:
    """Rows (member, component, n, sketch) by the bands of their sketches: bucket, member, component, n."""
    width = near.sketch_rows
    bands_ = SKETCH // width

    def deal(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            repeat = pa.array(np.repeat(np.arange(batch.num_rows), bands_))
            found = bands(sketch[:, : bands_ * width].astype(np.uint64), width)
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), *(batch.column(c).take(repeat) for c in ("member", "component", "n"))], names=["bucket", "member", "component", "n"])

    return rows.select("member", "component", "n", "sketch").mapInArrow(deal, "bucket long, member long, component long, n long")


def _several(rows: DataFrame) -> DataFrame:
    """The buckets of more than one component: bucket, all, shingles; and of the largest component major, most, most_shingles."""
    by_component = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("own"), F.sum("n").alias("held"))
    largest = F.max(F.struct("own", "component", "held"))
    found = by_component.groupBy("bucket").agg(F.sum("own").alias("all"), F.sum("held").alias("shingles"), largest.alias("top"))
    return found.select("bucket", "all", "shingles", F.col("top.component").alias("major"), F.col("top.own").alias("most"), F.col("top.held").alias("most_shingles")).filter(F.col("all") > F.col("most"))


def _confirmed(edges: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The edges (hub, member) with ``linked`` and ``distance``, from the full sets.

    A hub may have any number of edges, so they are dealt out by (hub, salt), and each
    salt has a copy of the hub's set: one copy for about EDGES_AT_ONCE edges.
    """
    salts = edges.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / EDGES_AT_ONCE).cast("int").alias("salts"))
    hubs = (
        sets.join(salts, sets["doc_id"] == salts["hub"])
        .select("hub", "salts", F.col("shingles").alias("hub_set"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    )
    dealt = edges.join(salts, "hub").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int")).drop("salts")
    members = sets.select(F.col("doc_id").alias("member"), F.col("shingles").alias("member_set"))
    both = dealt.join(members, "member").join(hubs.drop("salts"), ["hub", "salt"])
    shared = F.size(F.array_intersect("hub_set", "member_set")).cast("long")
    counted = both.select("hub", "member", shared.alias("shared"), (F.size("hub_set") + F.size("member_set")).cast("long").alias("total"))
    union = F.col("total") - F.col("shared")
    scored = counted.select("hub", "member", (F.col("shared") * 100 >= union * near.percent).alias("linked"), (1 - F.col("shared") / union).alias("distance"))
    # An id that several rows have may have several sets; it is as near as its nearest.
    return scored.groupBy("hub", "member").agg(F.max("linked").alias("linked"), F.min("distance").alias("distance"))


def links(classes: DataFrame, docs: DataFrame, near: Near, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Components of the stars' confirmed edges (node, component), and confirmed edges (hub, member) between these.

    Together they connect what any two classes of a bucket connect.

    What a bucket has to say to its classes (its size, its hub) is written first, so that the join can be
    dealt anew where one bucket has a large share of all classes.
    """
    spark = docs.sparkSession
    rows = classes.filter("bands is not null").select(F.explode("bands").alias("bucket"), F.col("rep").alias("member"), F.col("n_shingles").alias("n"))
    shared = rows.groupBy("bucket").agg(F.min("member").alias("first"), F.max("member").alias("last"), F.count(F.lit(1)).alias("size")).filter("first < last")
    shared = scratch.table(shared.select("bucket", "size"), "shared")
    state = scratch.table(sifted(rows, F.col("bucket"), scratch.table(bits_of(F.col("bucket"), shared), "shared-bits"), True).join(shared, "bucket"), "state")
    central = scratch.table(state.groupBy("member").agg(F.sum("size").alias("weight")), "central")
    state = state.drop("size").join(central, "member").select("bucket", "member", "n", "weight")
    ids = central.select(F.col("member").alias("doc_id"))
    # An inner join, as a semi join would be moved below the sieve; the ids are distinct.
    asked = sifted(docs, F.col("doc_id"), scratch.table(bits_of(F.col("doc_id"), ids), "central-bits"), True).join(ids.hint("merge"), "doc_id")
    sets = scratch.table(full_sets(asked, near), "sets")

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        return scratch.table(_confirmed(pairs.select(F.least("hub", "member").alias("hub"), F.greatest("hub", "member").alias("member")).distinct(), sets, near), name)

    top = F.max(F.struct("weight", (-F.col("member")).alias("id")))
    hubs = scratch.table(state.groupBy("bucket").agg(top.alias("top")).select("bucket", (-F.col("top.id")).alias("hub")), "hubs")
    met = scratch.table(state.join(hubs, "bucket").filter("member <> hub"), "met")
    checked = confirm(met, "checked")
    linked = checked.filter("linked").select("hub", "member").distinct()
    label = connected(linked, Scratch(spark, "near-dedup-star"))
    labelled = lambda d, c, to: d.join(label.select(F.col("node").alias(c), F.col("component").alias(to)), c, "left").withColumn(to, F.coalesce(to, c))
    named = met.select("bucket", "member", "n", "hub", F.least("hub", "member").alias("low"), F.greatest("hub", "member").alias("high"))
    known = named.join(checked.select(F.col("hub").alias("low"), F.col("member").alias("high"), "distance"), ["low", "high"])
    known = labelled(labelled(known, "member", "component"), "hub", "hub_component").withColumn("open", F.col("component") != F.col("hub_component"))
    after = scratch.table(known.select("bucket", "member", "n", "component", "open", "distance"), "after")
    left = scratch.table(after.filter("open").groupBy("bucket").agg(F.min("distance").alias("near_end"), F.max("distance").alias("far_end")), "left")
    slack = 1 - near.percent / 100 + 1e-9
    within = F.col("distance").between(F.col("near_end") - slack, F.col("far_end") + slack)
    kept = scratch.table(after.join(left, "bucket").filter(F.col("open") | within).select("bucket", "member", "n", "component"), "kept")
    # Buckets of one component are done.
    several = scratch.table(_several(kept), "several")
    fits = F.col("all") * (F.col("all") - F.col("most")) <= REST_PAIRS
    found = _links_of(_cells(kept, several.filter(fits), sets), near)
    if several.filter(~fits).limit(1).count():
        large = kept.join(several.filter(~fits).select("bucket"), "bucket").select("member", "component", "n").distinct()
        sketches = sets.select(F.col("doc_id").alias("member"), "sketch")
        again = scratch.table(_by_sketch(large.join(sketches, "member"), near), "again")
        found = found.unionByName(_links_of(_cells(again, scratch.table(_several(again), "several-again"), sets), near))
    rest = scratch.table(found.distinct(), "rest")
    scratch.drop("shared", "shared-bits", "state", "central", "central-bits", "hubs", "met", "checked", "after", "left", "kept", "several", "several-again", "again", "sets")
    return label, rest


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The smallest node that each node of the edges (hub, member) reaches: node, component.

    Large-star: every node's larger neighbours are joined to its smallest neighbour;
    small-star: its smaller ones. Edges never grow in number, and the rounds grow with
    the logarithm of the graph's size.
    """
    now = scratch.table(edges.select(F.greatest("hub", "member").alias("high"), F.least("hub", "member").alias("low")).filter("high <> low").distinct(), "star-0")
    state, turn = None, 0
    while True:
        both = now.unionByName(now.select(F.col("low").alias("high"), F.col("high").alias("low"))).select(F.col("high").alias("node"), F.col("low").alias("next"))
        lowest = both.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("lowest"))
        large = both.filter("next > node").join(lowest, "node").select(F.col("next").alias("high"), F.col("lowest").alias("low")).distinct()
        least = large.groupBy("high").agg(F.min("low").alias("lowest"))
        small = large.join(least, "high").select("high", "low", "lowest")
        stars = small.select("high", F.col("lowest").alias("low")).unionByName(small.select(F.col("low").alias("high"), F.col("lowest").alias("low"))).filter("high <> low").distinct()
        turn += 1
        seen = Observation()
        now = scratch.table(stars.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("mark")), f"star-{turn}")
        scratch.drop(f"star-{turn - 1}")
        if (was := state) == (state := seen.get):
            return now.select(F.col("high").alias("node"), F.col("low").alias("component"))


def components(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near-dedup")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = scratch.table(signed(given, near), "signed")
    key = ["n_shingles", "key_a", "key_b"]
    taking_part = rows.filter("doc_id is not null and n_shingles > 0")
    classes = scratch.table(taking_part.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"), F.first("bands").alias("bands")), "classes")
    label, between = links(classes, given, near, scratch)
    between = _with_repeats(between, taking_part, key, classes)
    if between.limit(1).count():
        label = connected(between.unionByName(label.select(F.col("component").alias("hub"), F.col("node").alias("member"))), scratch)
    reached = label
    labelled = classes.select(*key, "rep", "members").join(reached.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = scratch.table(labelled.select(*key, "members", F.coalesce("component", "rep").alias("component")), "labelled")
    # Large classes are looked up: a broadcast of few rows at any size.
    share, total = hot_share(spark), rows.count()
    hot = labelled.filter(F.col("members") * share >= max(total, share)).filter("members > 1")
    narrow = rows.select("doc_id", *key)
    first = narrow.join(F.broadcast(hot.select(*key, F.col("component").alias("hot"))), key, "left")
    lone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    done = first.filter(lone | F.col("hot").isNotNull()).select("doc_id", "n_shingles", F.when(lone, F.col("doc_id")).otherwise(F.col("hot")).alias("component_id"))
    cold = first.filter(~lone & F.col("hot").isNull()).drop("hot").join(labelled, key).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return done.unionByName(cold).withColumn("kept", _stays())


def _stays() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("component_id"))


def _with_repeats(edges: DataFrame, rows: DataFrame, key: list[str], classes: DataFrame) -> DataFrame:
    """The edges, and where an id has rows in several classes, edges between these."""
    several = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    if not several.limit(1).count():
        return edges
    tied = rows.join(several, "doc_id").join(classes.select(*key, "rep"), key).filter("doc_id <> rep")
    return edges.unionByName(tied.select(F.col("rep").alias("hub"), F.col("doc_id").alias("member")).distinct())


def keep_first(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns."""
    scratch = Scratch(docs.sparkSession, "near-keep")
    name = free_name(docs, "lost_id")
    lost = scratch.table(components(docs, near, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(name)).distinct(), "lost")
    return without_ids(docs, F.col(id_col).cast("long"), lost, scratch)
