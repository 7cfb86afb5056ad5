"""Micro-batches of updates over a state of edge versions, for Structured Streaming's foreachBatch.

The state is a table of versions in a folder shared by the cluster; batch n reads the state of batch n - 1, so
a batch that is run again after a failure starts from the same state and overwrites its own results. Updates are
matched on their own snapshots, so the cut into batches never changes a count. Batches must follow each
other in sequence; an update at or before the last one applied is an error, not silently moved.

A batch that arrives alone writes its own state. A bounded stream, whose batches are all there, is replayed in runs of
batches: a run is matched by one set of joins and writes one table with all versions alive at any of its times, of which the
state after each of its batches is a snapshot. Deltas and notes are kept for each batch all the same.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaweave.functions.scalars import OPEN, visible
from deltaweave.operators import matching, pruning, versions
from deltaweave.plans.query_graph import QueryGraph

#: Updates of a batch whose touched edges are sent to all tasks, so that the state stays where it is.
SMALL = 100_000
#: Updates that a replay takes in one run of batches at least, and the runs that it cuts a longer stream into.
RUN, RUNS = 1 << 20, 16


class OutOfOrder(ValueError):
    """An update isn't later than those already applied."""


@dataclass
class Cuts:
    """Where a stream with dense seq from 1 is cut into batches: first at `ends`, then after each `size` updates."""

    ends: list[int]
    size: int

    @classmethod
    def of(cls, n: int, size: int, warm_up: bool) -> Cuts:
        ends, at, step = [], 0, max(1, size // 16) if warm_up and n > size else size
        while step < size:
            at, step = at + step, min(size, step * 2)
            ends.append(at)
        return cls(ends, size)

    def end(self, batch: int) -> int:
        """The last place of a batch."""
        if batch < len(self.ends):
            return self.ends[batch] if batch >= 0 else 0
        return (self.ends[-1] if self.ends else 0) + (batch - len(self.ends) + 1) * self.size

    def count(self, n: int) -> int:
        """The number of batches of a stream that ends at n."""
        warm = self.end(len(self.ends) - 1)
        if n <= warm:
            return bisect_left(self.ends, n) + 1 if n > 0 else 0
        return len(self.ends) + (n - warm - 1) // self.size + 1

    def column(self) -> Column:
        """The batch of an update, by its seq."""
        out = F.expr(f"{len(self.ends)} + (seq - {self.end(len(self.ends) - 1) + 1}) div {self.size}")
        for batch, end in reversed(list(enumerate(self.ends))):
            out = F.when(F.col("seq") <= end, batch).otherwise(out)
        return out.cast("long")


class MatchingStream:
    """Applies batches of updates (seq, u, v, op, el) and appends their deltas under `path`/deltas."""

    def __init__(self, spark: SparkSession, path: str, initial: DataFrame, vertices: DataFrame, query: QueryGraph):
        """initial: the log's rows at seq <= 0 (or none); vertices: id, label, the same for the whole run."""
        self.spark, self.path, self.query = spark, path.rstrip("/"), query
        # Each batch reads the labels; kept, they aren't derived again.
        vertices.select("id", "label").write.mode("overwrite").parquet(f"{self.path}/vertices")
        self.vertices = spark.read.parquet(f"{self.path}/vertices")
        first = self._relevant(versions.versions(initial.where("seq <= 0"))).select("u", "v", "el", "ins", "del", "lu", "lv")
        self._columns = first.schema
        first.write.mode("overwrite").parquet(f"{self.path}/state/initial")
        #: The last batch advanced, its last update and its state's name, if this object knows them.
        self._at: tuple[int, int, str] | None = None
        self._note(-1, 0, "initial")
        # So that a stream without updates has deltas too.
        spark.range(0).select(F.col("id").alias("seq"), F.lit("I").alias("op"), F.col("id").alias("delta")).write.mode("overwrite").parquet(f"{self.path}/deltas/batch=-1")

    def _relevant(self, edges: DataFrame) -> DataFrame:
        """Edges or updates that can occur in an embedding, with their ends' labels; the state holds no others."""
        return pruning.relevant(versions.labelled_updates(edges, self.vertices), self.query)

    def _versions(self, state: str) -> DataFrame:
        """All versions alive at some time of the batch or run that wrote this state."""
        return self.spark.read.schema(self._columns).parquet(f"{self.path}/state/{state}")

    def _alive(self, state: str, last: int) -> DataFrame:
        """The edges after update `last` of that batch or run. Lifetimes that have ended can't be seen by later snapshots."""
        return self._versions(state).where(visible(F.lit(last), F.col("ins"), F.col("del"))).withColumn("del", F.lit(OPEN))

    def _effective(self, state: str, last: int) -> DataFrame:
        """The effective updates after `last` of that batch or run: each begins or ends a version."""
        ends = F.array(F.struct(F.col("ins").alias("seq"), F.col("ins").alias("th")), F.struct(F.col("del").alias("seq"), (F.col("del") - 1).alias("th")))
        return self._versions(state).select("u", "v", "el", "lu", "lv", F.inline(ends)).where((F.col("seq") > last) & (F.col("seq") < OPEN))

    def _note(self, batch: int, last: int, state: str) -> None:
        row = self.spark.range(1).select(F.lit(last).cast("long").alias("last"), F.lit(state).alias("state"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/applied/batch={batch}")

    def _by_batch(self, rows: DataFrame, folder: str, batches: int) -> None:
        """Writes a run's rows, each batch's into its own folder, which replaces an earlier one."""
        parts = min(batches, 2 * self.spark.sparkContext.defaultParallelism)
        rows.repartition(parts, "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{folder}")

    def _applied_before(self, batch: int) -> tuple[int, int, str]:
        if self._at and self._at[0] < batch:
            return self._at
        done = self.spark.read.parquet(f"{self.path}/applied").select(F.col("batch").cast("long").alias("batch"), "last", "state").where(F.col("batch") < batch)
        row = done.agg(F.max(F.struct("batch", "last", "state")).alias("x")).first().x
        return row.batch, row["last"], row.state

    def _advance(self, updates: DataFrame, batch: int, first: int | None = None, cuts: Cuts | None = None) -> tuple[Callable[[], None], Callable[[], None]] | None:
        """Writes the state after a batch, or after the run of batches from `first` on that `cuts` tells apart. Returns what
        writes the deltas, which later batches don't wait for, and what notes them as applied."""
        first = batch if first is None else first
        _, last, before = self._applied_before(first)
        # Named by both ends, so that a batch of a run that comes again doesn't replace the run's state, from which it starts.
        state = f"{first}-{batch}"
        updates = updates.persist()
        span = updates.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("d")).first()
        if not span.n:
            return None
        if span.lo <= last or span.n != span.d:
            raise OutOfOrder(f"updates from {span.lo} after {last} were applied, or equal sequence numbers")
        self._at = None  # until the state is written
        alive = self._alive(before, last)
        # A small batch is one task's, so that its windows need no shuffle.
        small = span.n <= SMALL
        log = versions.canonical_log(updates.coalesce(1) if small else updates, self.query.directed)
        log_ = self._relevant(log)
        # The open versions of touched edges enter as insertions before all updates; of a large batch those of all edges do,
        # as one window over them costs less than telling them apart.
        open_, rest = alive, None
        if small:
            touched = F.broadcast(log_.select("u", "v").distinct())
            open_, rest = alive.join(touched, ["u", "v"], "left_semi").repartition(1), alive.join(touched, ["u", "v"], "left_anti")
        open_ = open_.select(F.lit(0).cast("long").alias("seq"), "u", "v", F.lit("I").alias("op"), "el", F.col("ins").alias("_ins"), "lu", "lv")
        replay = log_.withColumn("_ins", F.lit(None).cast("long")).select(*open_.columns).unionByName(open_)
        replay = replay.coalesce(1) if small else replay
        w = W.partitionBy("u", "v").orderBy("seq")
        lives = versions.effective(replay).withColumn("_next", F.lead("seq").over(w)).where("op = 'I'").select("u", "v", "el", F.coalesce("_ins", "seq").alias("ins"), F.coalesce("_next", F.lit(OPEN)).alias("del"), "lu", "lv")
        (rest.unionByName(lives) if small else lives).write.mode("overwrite").parquet(f"{self.path}/state/{state}")
        self._at = (batch, span.hi, state)

        def match() -> None:
            found = matching.delta_matches(log, self._effective(state, last), versions.entries(self._versions(state), self.query.directed), self.query)
            if cuts:
                self._by_batch(found.withColumn("batch", cuts.column()), "deltas", batch - first + 1)
            else:
                found.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")

        def note() -> None:
            if cuts:
                notes = updates.groupBy(cuts.column().alias("batch")).agg(F.max("seq").alias("last")).withColumn("state", F.lit(state))
                self._by_batch(notes, "applied", batch - first + 1)
            else:
                self._note(batch, span.hi, state)
            updates.unpersist()

        return match, note

    def apply(self, updates: DataFrame, batch: int) -> None:
        """One micro-batch."""
        if step := self._advance(updates, batch):
            try:
                for do in step:
                    do()
            except BaseException:
                self._at = None
                raise

    def replay(self, log: DataFrame, size: int, at_once: int = 4) -> int:
        """A bounded stream in the batches of in_batches, which are applied in runs. States follow each other; up to `at_once` runs are
        matched meanwhile, and noted in order. Returns the number of batches."""
        log = log.where("seq > 0")
        span = log.agg(F.max("seq").alias("hi"), F.count(F.lit(1)).alias("n")).first()
        cuts = Cuts.of(span.hi or 0, size, warm_up=True)
        earlier = F.coalesce(F.sum("n").over(W.orderBy("batch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = log.groupBy(cuts.column().alias("batch")).agg(F.count(F.lit(1)).alias("n"))
        runs = counts.select("batch", F.floor(earlier / max(RUN, span.n // RUNS)).alias("run")).groupBy("run").agg(F.min("batch").alias("first"), F.max("batch").alias("last")).collect()
        waiting: deque[tuple[Future, Callable[[], None]]] = deque()

        def settle(most: int) -> None:
            while len(waiting) > most:
                done, note = waiting.popleft()
                done.result()
                note()

        with ThreadPoolExecutor(at_once) as pool:
            try:
                for run in sorted(runs, key=lambda r: r.first):
                    settle(at_once - 1)
                    match, note = self._advance(log.where((F.col("seq") > cuts.end(run.first - 1)) & (F.col("seq") <= cuts.end(run.last))), run.last, run.first, cuts)
                    # Threads get the caller's job group, so that what cancels it cancels them too.
                    waiting.append((pool.submit(inheritable_thread_target(self.spark)(match)), note))
                settle(0)
            except BaseException:
                self._at = None
                raise
        return cuts.count(span.hi or 0)

    def deltas(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/deltas").select("seq", "op", "delta")

    def start(self, updates: DataFrame, checkpoint: str, *, until_done: bool = True):
        """Runs a streaming DataFrame of updates through the engine."""
        writer = updates.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if until_done else writer).start()


def in_batches(log: DataFrame, size: int, apply: Callable[[DataFrame, int], None], *, warm_up: bool = True) -> int:
    """Feeds a bounded stream (dense seq from 1) in batches of `size`; a long one begins with a sixteenth of it and doubles. Returns the number of batches."""
    n = log.where("seq > 0").agg(F.max("seq")).first()[0] or 0
    cuts = Cuts.of(n, size, warm_up)
    for batch in range(cuts.count(n)):
        apply(log.where((F.col("seq") > cuts.end(batch - 1)) & (F.col("seq") <= cuts.end(batch))), batch)
    return cuts.count(n)
