"""A bounded stream through the engine: what batches derive again, and that matching meanwhile changes nothing."""

import random

import pytest
from pyspark.sql import functions as F

from deltaweave.streaming.engine import Cuts, MatchingStream, OutOfOrder, in_batches
from tests.test_matching import QUERIES, frames, random_log


def test_labels_are_derived_once(spark, tmp_path):
    """Each batch used to derive the labels again, which for the hand-off stream meant the whole log."""
    q = QUERIES["triangle"]
    log_rows, labels, want, _, _ = random_log(random.Random(5), q, 7, 8, 30)
    log, vertices = frames(spark, log_rows, labels, q)
    read = spark.sparkContext.accumulator(0)

    def noted(label):
        read.add(1)
        return label

    vertices = vertices.select("id", F.udf(noted, "long").asNondeterministic()("label").alias("label"))
    engine = MatchingStream(spark, str(tmp_path), log, vertices, q)
    assert in_batches(log, 10, engine.apply, warm_up=False) == 3
    assert {r.seq: r.delta for r in engine.deltas().collect()} == want
    assert read.value == len(labels)


def test_replay_equals_recount_and_goes_on(spark, tmp_path):
    q = QUERIES["labelled"]
    log_rows, labels, want, _, _ = random_log(random.Random(6), q, 7, 8, 40)
    log, vertices = frames(spark, log_rows, labels, q)
    engine = MatchingStream(spark, str(tmp_path), log, vertices, q)
    n = engine.replay(log.where("seq <= 32"), 8)
    engine.apply(log.where("seq > 32"), n)
    assert {r.seq: r.delta for r in engine.deltas().collect()} == want
    notes = {r.batch: r["last"] for r in spark.read.parquet(f"{tmp_path}/applied").collect()}
    assert [notes[b] for b in sorted(notes)] == sorted(notes.values()) and max(notes.values()) == 40
    with pytest.raises(OutOfOrder):
        engine.apply(log.where("seq = 3"), 99)


def test_batches_are_applied_in_runs(spark, tmp_path):
    """Each batch used to write a state and to be matched by jobs of its own, those without an update to be looked for."""
    q = QUERIES["triangle"]
    log_rows, labels, want, _, _ = random_log(random.Random(7), q, 7, 8, 40)
    log, vertices = frames(spark, log_rows, labels, q)
    apart = log.withColumn("seq", F.when(F.col("seq") > 0, F.col("seq") * 50).otherwise(F.col("seq")))
    engine = MatchingStream(spark, str(tmp_path), apart, vertices, q)
    spark.sparkContext.setJobGroup("replay", "replay")
    try:
        assert engine.replay(apart, 16) == 129
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("replay")) < 80
    assert {r.seq: r.delta for r in engine.deltas().collect()} == {50 * s: n for s, n in want.items()}
    notes = {r.batch: r["last"] for r in spark.read.parquet(f"{tmp_path}/applied").collect()}
    assert notes == {-1: 0} | {4 + (50 * s - 16) // 16: 50 * s for s in range(1, 41)}


def test_batches_of_a_run_come_again(spark, tmp_path, monkeypatch):
    """Each starts from the state of the batch before it, inside a run too, and for an engine that begins anew."""
    q = QUERIES["labelled"]
    log_rows, labels, want, _, _ = random_log(random.Random(8), q, 7, 8, 40)
    log, vertices = frames(spark, log_rows, labels, q)
    monkeypatch.setattr("deltaweave.streaming.engine.RUN", 16)
    engine = MatchingStream(spark, str(tmp_path), log, vertices, q)
    assert engine.replay(log.where("seq <= 31"), 8) == 6
    cuts = Cuts.of(31, 8, warm_up=True)
    engine = MatchingStream(spark, str(tmp_path), log, vertices, q)
    engine.apply(log.where("seq > 31"), 6)
    for batch in (3, 4, 2, 5):
        rows = log.where(f"seq > {cuts.end(batch - 1)} and seq <= {cuts.end(batch)}")
        spark.createDataFrame([(0, "I", -1)], "seq long, op string, delta long").write.mode("overwrite").parquet(f"{tmp_path}/deltas/batch={batch}")
        engine.apply(rows, batch)
        assert {r.seq: r.delta for r in engine.deltas().collect()} == want


@pytest.mark.parametrize("n, size, warm_up", [(0, 4, True), (7, 8, True), (32, 8, True), (33, 8, False), (18, 17, True), (100, 16, True), (5, 1, True)])
def test_cuts(spark, n, size, warm_up):
    cuts, step, ends = Cuts.of(n, size, warm_up), max(1, size // 16) if warm_up and n > size else size, []
    while not ends and n or ends and ends[-1] < n:
        ends.append((ends[-1] if ends else 0) + step)
        step = min(size, step * 2)
    assert cuts.count(n) == len(ends) and [cuts.end(b) for b in range(-1, len(ends))] == [0, *ends]
    found = {r.seq: r.batch for r in spark.range(1, n + 1).select(F.col("id").alias("seq")).select("seq", cuts.column().alias("batch")).collect()}
    assert found == {s: next(b for b, end in enumerate(ends) if s <= end) for s in range(1, n + 1)}


def test_no_updates(spark, tmp_path):
    q = QUERIES["triangle"]
    log_rows, labels, *_ = random_log(random.Random(9), q, 7, 8, 10)
    log, vertices = frames(spark, log_rows, labels, q)
    engine = MatchingStream(spark, str(tmp_path), log, vertices, q)
    assert engine.replay(log.where("seq <= 0"), 8) == 0
    assert engine.deltas().collect() == []
