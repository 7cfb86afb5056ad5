"""Delta joins against a recount after every update."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from deltaweave.operators import matching, pruning, statistics, versions
from deltaweave.plans.match_plan import LEAF_LAST, RARE_FIRST, build_plans, closure_requirements, explain, maps_to, set_partitions
from deltaweave.plans.query_graph import QueryGraph
from deltaweave.streaming.engine import MatchingStream, OutOfOrder, in_batches

U = lambda labels, *edges: QueryGraph(list(labels), {e[:2]: (e[2] if len(e) > 2 else None) for e in edges})
D = lambda labels, *edges: QueryGraph(list(labels), {e[:2]: (e[2] if len(e) > 2 else None) for e in edges}, True)
QUERIES = {
    "edge": U((0, 1), (0, 1)),
    "triangle": U((0, 0, 1), (0, 1), (1, 2), (0, 2)),
    "same triangle": U((0, 0, 0), (0, 1), (1, 2), (0, 2)),
    "path": U((0, 1, 0), (0, 1), (1, 2)),
    "cycle": U((0, 0, 0, 1), (0, 1), (1, 2), (2, 3), (0, 3)),
    "star": U((0, 0, 0, 1), (0, 1), (0, 2), (0, 3)),
    "diamond": U((0, 1, 0, 0), (0, 1), (0, 2), (1, 2), (0, 3), (1, 3)),
    "labelled": U((0, 0, 1), (0, 1, 5), (1, 2)),
    "directed": D((0, 0, 1), (0, 1), (1, 2)),
    "back and forth": D((0, 0, 0), (0, 1), (1, 0), (1, 2)),
    "directed labelled": D((0, 0, 0), (0, 1, 5), (1, 2, 6), (2, 0)),
}


def recount(edges, labels, q):
    """edges: (u, v) -> label."""
    n = 0
    has = lambda a, b, el: ((a, b) if q.directed else (min(a, b), max(a, b))) in edges and (not q.labelled or edges[(a, b) if q.directed else (min(a, b), max(a, b))] == el)
    for m in permutations(labels, q.k):
        if all(labels[x] == q.labels[i] for i, x in enumerate(m)) and all(has(m[a], m[b], el) for (a, b), el in q.edges.items()):
            n += 1
    return n


def random_log(rng, q, n_vertices, n_start, n_stream):
    labels = {i: rng.choice([0, 0, 1]) for i in range(n_vertices)}
    log, edges, want = [], {}, {}
    pairs = [(a, b) for a in labels for b in labels if a != b]
    for _ in range(n_start):
        a, b = rng.choice(pairs)
        key = (a, b) if q.directed else (min(a, b), max(a, b))
        if key not in edges:
            edges[key] = rng.choice([None, 5, 6])
            log.append((0, *key, "I", edges[key]))
    before = recount(edges, labels, q)
    first = before
    for seq in range(1, n_stream + 1):
        a, b = rng.choice(pairs)
        key = (a, b) if q.directed else (min(a, b), max(a, b))
        op, el = rng.choice("IID"), rng.choice([None, 5, 6])
        if op == "I" and key not in edges:
            edges[key] = el
        elif op == "D":
            edges.pop(key, None)
        now = recount(edges, labels, q)
        want[seq] = abs(now - before)
        before = now
        log.append((seq, a, b, op, el))
    return log, labels, want, first, before


def frames(spark, log, labels, q):
    raw = spark.createDataFrame(log, "seq long, u long, v long, op string, el long")
    return versions.canonical_log(raw, q.directed), spark.createDataFrame(list(labels.items()), "id long, label long")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_deltas_equal_recount(spark, name):
    q = QUERIES[name]
    log_rows, labels, want, first, last = random_log(random.Random(name), q, 8, 9, 45)
    log, vertices = frames(spark, log_rows, labels, q)
    eff = versions.labelled_updates(versions.effective_updates(log), vertices).cache()
    adj = versions.adjacency(versions.versions(log), vertices, q.directed).cache()
    updates = log.where("seq > 0")
    stats = statistics.collect_statistics(adj, vertices, q.labels)
    ways = [dict(), dict(stats=stats, kind=RARE_FIRST)]
    if name in ("cycle", "star", "back and forth"):
        ways += [dict(joint=False, merge=False), dict(kind=LEAF_LAST, merge=False), dict(count_tails=True)]
    for options in ways:
        got = {r.seq: r.delta for r in matching.delta_matches(updates, eff, adj, q, **options).collect()}
        assert got == want, options
    assert matching.static_count(adj, q, 0).first()[0] == first
    assert matching.static_count(adj, q, 10**6).first()[0] == last
    hit = {s for s, n in want.items() if n}
    for pruned in (pruning.relevant(eff, q), pruning.pruned_updates(eff, adj, q), pruning.closure_filter(eff, adj, q)):
        assert hit <= {r.seq for r in pruned.collect()}


@pytest.mark.parametrize("name", ["triangle", "labelled", "back and forth"])
def test_stream_equals_batch(spark, tmp_path, name):
    q = QUERIES[name]
    log_rows, labels, want, _, _ = random_log(random.Random(name + "s"), q, 7, 8, 40)
    log, vertices = frames(spark, log_rows, labels, q)
    engine = MatchingStream(spark, str(tmp_path / "a"), log, vertices, q)
    assert in_batches(log, 16, engine.apply) == 6
    assert {r.seq: r.delta for r in engine.deltas().collect()} == want
    engine.apply(log.where("seq > 31"), 5)  # the last batch again: the same state, the same rows
    assert {r.seq: r.delta for r in engine.deltas().collect()} == want
    with pytest.raises(OutOfOrder):
        engine.apply(log.where("seq = 3"), 99)


def test_structured_streaming(spark, tmp_path):
    q = QUERIES["triangle"]
    log_rows, labels, want, _, _ = random_log(random.Random(4), q, 7, 8, 30)
    log, vertices = frames(spark, log_rows, labels, q)
    for i in range(3):
        log.where(f"seq > {10 * i} and seq <= {10 * i + 10}").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    engine = MatchingStream(spark, str(tmp_path / "b"), log, vertices, q)
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = engine.start(source, str(tmp_path / "cp"))
    query.awaitTermination(240)
    assert {r.seq: r.delta for r in engine.deltas().collect()} == want


def test_hot_edge_in_chunks(spark):
    rng = random.Random(3)
    log = spark.createDataFrame([(s, 1, 2 if rng.random() < 0.7 else rng.randrange(3, 6), rng.choice("ID"), s % 4) for s in range(1, 600)], "seq long, u long, v long, op string, el long")
    key = lambda df: sorted(map(tuple, df.collect()))
    for f in (versions.effective, versions.versions):
        assert key(f(log).select("u", "v", "el")) == key(f(log, 50).select("u", "v", "el"))
    assert key(versions.versions(log)) == key(versions.versions(log, 7))


def test_small_versions_cases(spark):
    log = spark.createDataFrame([(-3, 1, 2, "I", 1), (-1, 1, 2, "D", None), (2, 1, 2, "I", 7), (3, 1, 2, "I", 8), (4, 2, 3, "D", None), (5, 1, 2, "D", 9)], "seq long, u long, v long, op string, el long")
    assert [tuple(r) for r in versions.versions(log).collect()] == [(1, 2, 7, 2, 5)]
    eff = sorted(tuple(r) for r in versions.effective_updates(log).select("seq", "op", "th", "el").collect())
    assert eff == [(2, "I", 2, 7), (5, "D", 4, 7)]
    assert versions.versions(log.limit(0)).count() == 0
    assert versions.needs_compaction(1024, 200, 57) and not versions.needs_compaction(1024, 200, 56)


def test_dedup_label_rule(spark):
    edges = spark.createDataFrame([(1, 2, 9, 1), (2, 1, 4, 2), (3, 4, 4, 3), (3, 4, 9, 4), (5, 6, 4, 5), (6, 5, None, 6), (7, 7, 1, 7)], "u long, v long, el long, at long")
    got = {(r.u, r.v): r.el for r in versions.dedup_edges(edges, False).collect()}
    assert got == {(1, 2): 9, (3, 4): 9, (5, 6): None}


def test_plans():
    t = QUERIES["same triangle"]
    assert [p.weight for p in build_plans(t)] == [6] and len(build_plans(t, merge=False)) == 6
    assert maps_to(QUERIES["path"], {0: 2, 1: 1}) and not maps_to(QUERIES["path"], {0: 1, 1: 0})
    assert build_plans(QUERIES["star"])[0].tail == 2
    assert len(set_partitions(list(range(5)))) == 52
    assert closure_requirements(QUERIES["diamond"], 0, 1) == [(0, ((False, 0), (True, 0)), 2)]
    assert "anchor 0->1" in explain(t, build_plans(t))


def test_signature_counters(spark):
    rng = random.Random(9)
    edges = {tuple(sorted(rng.sample(range(12), 2))) for _ in range(30)}
    labels = {i: i % 2 for i in range(12)}
    log = spark.createDataFrame([(0, u, v, "I", None) for u, v in edges], "seq long, u long, v long, op string, el long")
    vertices = spark.createDataFrame(list(labels.items()), "id long, label long")
    adj = versions.adjacency(versions.versions(log), vertices, False)
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in range(12)}
    two = {}
    for v in near:
        for w in near[v]:
            for x in near[w] - {v}:
                two[v, labels[w], labels[x]] = two.get((v, labels[w], labels[x]), 0) + 1
    assert {(r.id, r.label1, r.label2): r.n for r in statistics.curvature(adj).collect()} == two
    deg = {(r.id): r.t4 for r in statistics.staircase(adj).groupBy("id").agg(F.sum("t4").alias("t4")).collect()}
    assert deg == {v: sum(len(near[w]) >= 4 for w in near[v]) for v in near if near[v]}


def test_hub_is_not_expanded(spark):
    """One vertex with 20,000 edges: rows expand from their other end, so few wedges are ever built."""
    q = U((0, 1, 2), (0, 1), (1, 2), (0, 2))
    n = 20_000
    rows = [(0, 0, 10 + i, "I", None) for i in range(n)]
    rows += [(i + 1, 10 + i, 10 + n // 2 + i, "I", None) for i in range(500)]
    log = spark.createDataFrame(rows, "seq long, u long, v long, op string, el long")
    vertices = spark.range(10, 10 + n).selectExpr("id", f"if(id < {10 + n // 2}, 1, 2) as label").unionByName(spark.createDataFrame([(0, 0)], "id long, label long"))
    eff = versions.labelled_updates(versions.effective_updates(log), vertices)
    adj = versions.adjacency(versions.versions(log), vertices, False)
    assert [r.delta for r in matching.delta_counts(eff, adj, q).collect()] == [1] * 500
