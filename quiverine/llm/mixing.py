"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight, which says how many words the mix takes of it, and a
schedule, which says when. A source's documents stand in an order by hash, as often
as its target needs. The schedule's integral is the share of the target that is due by
a time; inverting it gives each copy of a document its position in training, and rows
are range-sorted by position.

Defined results: a null text has size 0; the null source is a source of its own, last
in order; a target is 3 times its source's size at most, so that no document is taken
more than 3 times; documents of size 0 are taken like others and add no words; ties of
hashes are in order of ids, sizes and texts; repeated ids are documents of their own; an empty table
gives no rows; further columns are not read, or are kept as they are (``mixed``).

Only whole documents are taken: those that end before the target in their source's
order, and then the one document whose size comes nearest to what is still missing.
That is what the SQL says; where a long document straddles the target, it can leave
much of it missing. With ``fill``, documents that fit what is missing are taken in
between, in the same order, those with the fewest copies first, until none fits. A
source then misses its target by half of its smallest document with copies left at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, free_name, running, ship, split_count, text_of

#: A target is so many times its source's size at most.
MOST_EPOCHS = 3
#: Sources that a plan may have; it is made on the driver.
MOST_SOURCES = 1_000_000
#: So many documents that may still fit are dealt with on the driver; more of them by running totals.
FEW_LEFT = 20_000


@dataclass(frozen=True)
class Schedule:
    """A weight over time, linear between knots that run from time 0 to time 1."""

    times: tuple[float, ...] = (0.0, 1.0)
    weights: tuple[float, ...] = (1.0, 1.0)

    def time_of(self, share: np.ndarray) -> np.ndarray:
        """The times by which the given shares of the integral are due."""
        t, w = np.array(self.times), np.array(self.weights)
        step = np.diff(t)
        due = np.concatenate([[0.0], np.cumsum(step * (w[1:] + w[:-1]) / 2)])
        wanted = np.clip(share, 0, 1) * due[-1]
        at = np.clip(np.searchsorted(due, wanted, "right") - 1, 0, len(step) - 1)
        rest, slope = np.maximum(wanted - due[at], 0), (w[1:] - w[:-1])[at] / step[at]
        below = w[at] + np.sqrt(np.maximum(w[at] ** 2 + 2 * slope * rest, 0))
        return np.minimum(t[at] + np.divide(2 * rest, below, out=np.zeros_like(rest), where=below > 0), t[at + 1])


#: Steady, falling and rising: the schedules of a curriculum by turns.
CURRICULUM = (Schedule(), Schedule(weights=(1.5, 0.5)), Schedule(weights=(0.5, 1.5)))


def by_turns(options: Sequence) -> Callable[[int], object]:
    return lambda i: options[i % len(options)]


def targets(sizes: Sequence[int], weights: Sequence[float], epochs: int = MOST_EPOCHS) -> list[float]:
    """Words to take of each source: all words shared by weight, none above ``epochs`` times its size.

    The sources that are full first are those with the least room for each unit of
    weight; what they leave is shared among the rest by weight.
    """
    order = sorted(range(len(sizes)), key=lambda i: (epochs * sizes[i] / weights[i], i))
    left, weight = sum(sizes), sum(weights)
    out = [0.0] * len(sizes)
    full = True
    for i in order:
        if full and epochs * sizes[i] * weight <= weights[i] * left:
            out[i] = float(epochs * sizes[i])
            left, weight = left - epochs * sizes[i], weight - weights[i]
        else:
            full = False
            out[i] = weights[i] * (left / weight)
    return out


@dataclass(frozen=True)
class Step:
    """One run of documents that fill up a source: those with ``level`` copies and ``gap`` words at most, up to the one after ``last`` words."""

    level: int
    gap: float
    first: int
    last: int
    words: int


def steps_of(size: np.ndarray, before: np.ndarray, copies: np.ndarray, gap: float, epochs: int) -> list[Step]:
    """The steps that fill up one source with its documents, given in order."""
    copies, out = copies.copy(), []
    while (fits := (size > 0) & (size <= gap) & (copies < epochs)).any():
        level = int(copies[fits].min())
        at = np.flatnonzero(fits & (copies == level))
        at = at[: np.searchsorted(np.cumsum(size[at]), gap, "right")]
        out.append(Step(level, gap, int(before[at[0]]), int(before[at[-1]]), int(size[at].sum())))
        copies[at] += 1
        gap -= out[-1].words
    return out


def filling(counted: DataFrame, scratch: Scratch, gaps: dict[str | None, float], epochs: int) -> dict[str | None, list[Step]]:
    """The steps that fill up each source; what is missing is taken off ``gaps``.

    The documents that still fit are few or become fewer with each step, as what is
    missing does.
    """
    spark, steps = counted.sparkSession, {source: [] for source in gaps}
    key = F.col("source").eqNullSafe(F.col("source_"))

    def beside(left: DataFrame, fields: str, rows: list[tuple]) -> DataFrame:
        return left.join(F.broadcast(spark.createDataFrame(rows, f"source_ string, {fields}")), key)

    def done(source: str | None, step: Step) -> None:
        steps[source].append(step)
        gaps[source] -= step.words

    left = beside(counted.select("source", "size", "before_size", "copies"), "gap double", list(gaps.items()))
    left = left.filter((F.col("size") > 0) & (F.col("size") <= F.col("gap")) & (F.col("copies") < epochs)).drop("source_", "gap")
    left, number = scratch.table(left, "left-0"), 0
    while True:
        found = left.limit(FEW_LEFT + 1).toPandas()
        if len(found) <= FEW_LEFT:
            found["source"] = found["source"].astype(object).where(found["source"].notna(), None)
            for source, own in found.sort_values("before_size").groupby("source", dropna=False):
                source = None if source != source else source
                for step in steps_of(own["size"].to_numpy(), own["before_size"].to_numpy(), own["copies"].to_numpy(), gaps[source], epochs):
                    done(source, step)
            scratch.drop(f"left-{number}")
            return steps
        levels = [(r.source, gaps[r.source], r.level) for r in left.groupBy("source").agg(F.min("copies").alias("level")).collect()]
        level = beside(left, "gap double, level long", levels).filter("copies = level").select("source", "before_size", "gap", "level", F.col("size").alias("words"))
        order = running(level, scratch, f"order-{number}", [F.col("source"), F.col("before_size")], "source", ["words"]).filter("before_words + words <= gap")
        taken = order.groupBy("source").agg(F.first("level").alias("level"), F.min("before_size").alias("first"), F.max("before_size").alias("last"), F.sum("words").alias("words")).collect()
        last = [(r.source, r.level, r["last"]) for r in taken]
        for r in taken:
            done(r.source, Step(r.level, gaps[r.source], r["first"], r["last"], r.words))
        now = beside(left, "level long, last long, gap double", [(*r, gaps[r[0]]) for r in last])
        copies = F.col("copies") + ((F.col("copies") == F.col("level")) & (F.col("before_size") <= F.col("last"))).cast("long")
        now = now.withColumn("copies", copies).filter((F.col("size") <= F.col("gap")) & (F.col("copies") < epochs))
        left, number = scratch.table(now.select("source", "size", "before_size", "copies"), f"left-{number + 1}"), number + 1
        scratch.drop(f"left-{number - 1}", f"order-{number - 1}")


def print_of(text_col: str, source_col: str) -> Column:
    """Tells rows of one id apart: a hash of text and source."""
    return F.xxhash64(F.col(text_col), F.col(source_col).cast("string"))


def placed(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = (1, 2, 3), schedules: Sequence[Schedule] = CURRICULUM, epochs: int = MOST_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", fill: bool = False) -> DataFrame:
    """One row per document: doc_id, print, size, source_size, target, taken, positions (of its copies, ascending).

    Only ids, sources and sizes move. Running totals over range partitions give each
    document its place in its source's order, so a source may hold any share of the rows.
    """
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        print_of(text_col, source_col).alias("print"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text_of(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long").alias("draw"),
    )
    sizes = scratch.table(narrow, "sizes")
    found = sizes.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    weight, schedule = by_turns(weights), by_turns(schedules)
    wanted = targets([r["size"] for r in found], [weight(i) for i in range(len(found))], epochs)
    plan = {r.source: (r["size"], t, schedule(i)) for i, (r, t) in enumerate(zip(found, wanted, strict=True))}

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sources = batch.column("source").to_pylist()
            size, before = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "before_size"))
            total, target = np.array([plan[s][0] for s in sources], np.int64), np.array([plan[s][1] for s in sources])
            ends = np.stack([before + size + k * total for k in range(epochs)], 1)
            copies = (ends <= target[:, None]).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copies)], names=[*batch.schema.names, "copies"])

    ordered = running(sizes, scratch, "ordered", [F.col(c) for c in ("source", "draw", "doc_id", "size", "print")], "source", ["size"])
    kind = dict(sizes.dtypes)["doc_id"]
    fields = f"doc_id {kind}, print long, source string, size long, draw long, before_size long"
    counted = scratch.table(ordered.select("doc_id", "print", "source", "size", "draw", "before_size").mapInArrow(count, f"{fields}, copies long"), "counted")
    # What is missing of each source, the documents that fill it up, and the one that comes nearest to the rest.
    gaps = {r.source: plan[r.source][1] - r.taken for r in counted.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()}
    steps = filling(counted, scratch, gaps, epochs) if fill and gaps else {}

    def fill_up(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sources = np.array(batch.column("source").to_pylist(), object)
            size, before, copies = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "before_size", "copies"))
            shares = [[] for _ in range(len(size))]
            copies = copies.copy()
            for s in set(sources.tolist()):
                own = np.array([x == s for x in sources], bool)
                for step in steps[s]:
                    at = np.flatnonzero(own & (size > 0) & (size <= step.gap) & (copies == step.level) & (before <= step.last))
                    copies[at] += 1
                    along = (before[at] - step.first) / max(step.last - step.first, 1)
                    for i, share in zip(at.tolist(), (1 - (step.gap - along * step.words) / plan[s][1]).tolist(), strict=True):
                        shares[i].append(share)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(copies), pa.array(shares, pa.list_(pa.float64()))], names=[*batch.schema.names, "shares"])

    filled = counted.withColumn("shares", F.lit(None).cast("array<double>"))
    if steps:
        filled = scratch.table(counted.mapInArrow(fill_up, f"{fields}, copies long, shares array<double>"), "filled")
    missing = spark.createDataFrame(list(gaps.items()), "gap_source string, gap double")
    off = F.abs(F.col("size") - F.col("gap"))
    fitting = filled.join(F.broadcast(missing), F.col("source").eqNullSafe(F.col("gap_source"))).filter((F.col("copies") < epochs) & (F.col("size") > 0) & (off < F.col("gap")))
    best = fitting.groupBy("source").agg(F.min(F.struct(off.alias("off"), "draw", "doc_id", "before_size")).alias("best"))
    extra = {r.source: (r.best.draw, r.best.before_size) for r in best.collect()}

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sources = batch.column("source").to_pylist()
            size, before, draw, copies = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "before_size", "draw", "copies"))
            total, target = np.array([plan[s][0] for s in sources], np.int64), np.array([plan[s][1] for s in sources])
            added = np.array([s in extra and extra[s] == (d, b) for s, d, b in zip(sources, draw.tolist(), before.tolist(), strict=True)], bool) & (size > 0)
            middle = np.stack([before + k * total for k in range(epochs)], 1) + size[:, None] / 2
            share = np.divide(middle, target[:, None], out=np.zeros_like(middle), where=target[:, None] > 0)
            # Documents that fill up a source come at the end of its target.
            for i, late in enumerate(batch.column("shares").to_pylist()):
                if late:
                    share[i, copies[i] - len(late) : copies[i]] = late
            share[added, copies[added]] = 1 - size[added] / 2 / target[added]
            copies = copies + added
            times = np.zeros_like(share)
            for s in set(sources):
                own = np.array([x == s for x in sources])
                times[own] = plan[s][2].time_of(share[own].ravel()).reshape(-1, epochs)
            offsets = np.concatenate([[0], np.cumsum(copies)])
            flat = np.concatenate([np.sort(t[:n]) for t, n in zip(times, copies.tolist(), strict=True)] or [np.zeros(0)])
            columns = [batch.column("doc_id"), batch.column("print"), batch.column("size"), pa.array(total), pa.array(target), pa.array(size * copies), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "print", "size", "source_size", "target", "taken", "positions"])

    out = filled.mapInArrow(place, f"doc_id {kind}, print long, size long, source_size long, target double, taken long, positions array<double>")
    table = scratch.table(out, "placed")
    scratch.drop("sizes", "ordered", "counted", *(["filled"] if steps else []))
    return table


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """``placed``, range-sorted by first position; documents that aren't taken come first, by their null position."""
    scratch = Scratch(docs.sparkSession, "mixing")
    table = placed(docs, scratch, **options).withColumn("position", F.expr("get(positions, 0)"))
    return table.repartitionByRange(split_count(docs.sparkSession), "position", "doc_id").sortWithinPartitions("position", "doc_id")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The mix itself: the documents' rows with all their columns, as often as they are taken, in training order.

    Rows of one id are told apart by text and source. Rows that repeat these as well are taken by a hash of their
    other columns, where these can be hashed, so that runs agree.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    own, print_, own_print, places, number, position = (free_name(docs, n) for n in ("own_id", "print", "own_print", "places", "number", "position"))
    table = placed(docs, scratch, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    table = table.select(F.col("doc_id").alias(own), F.col("print").alias(own_print), F.col("positions").alias(places))
    given = docs.withColumn(print_, print_of(text_col, source_col))
    on = F.col(id_col).eqNullSafe(F.col(own)) & (F.col(print_) == F.col(own_print))
    if table.groupBy(own, own_print).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").limit(1).count():
        rest = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        order = F.row_number().over(Window.partitionBy(own, own_print).orderBy(F.get(places, F.lit(0)).asc_nulls_last(), F.size(places).desc()))
        table = scratch.table(table.withColumn(f"{number}_", order), "numbered")
        given = given.withColumn(number, F.row_number().over(Window.partitionBy(id_col, print_).orderBy(F.xxhash64(*rest))))
        joined = given.join(table.filter(F.size(places) > 0), on & (F.col(number) == F.col(f"{number}_"))).drop(number, f"{number}_")
    else:
        # Both sides grow with the input: never a broadcast.
        joined = given.join(table.filter(F.size(places) > 0).hint("merge"), on)
    copies = joined.drop(own, print_, own_print).withColumn(position, F.explode(places)).drop(places)
    return copies.repartitionByRange(split_count(docs.sparkSession), position, id_col).sortWithinPartitions(position, id_col).drop(position)
