from collections import defaultdict

from deltaweave.llm import mixing as m


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


def test_targets_and_taken(spark, sf):
    rows = m.op7_mixing(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        s = docs[r.doc_id].source
        sizes[s] += r.size
        taken[s] += r.taken
        biggest[s] = max(biggest[s], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    want = brute_targets(dict(sizes))
    for r in rows:
        s = docs[r.doc_id].source
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
    assert all(abs(taken[s] - want[s]) <= biggest[s] / 2 + 1e-6 for s in sizes)
    again = {(r.doc_id, r.taken) for r in m.op7_mixing(spark, sf).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mix_equals_brute_force_plan(spark):
    """Which documents are taken: each source's permutation whole passes over, then its beginning up to the nearest stop."""
    rows = [(i, f"{i} " + "w " * (i * 7 % 23), "abc"[i % 3] if i % 5 else "big") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    h = {r.doc_id: r.h % 2**64 for r in df.select("doc_id", m.permuted("doc_id", "text", 17).alias("h")).collect()}
    size = {i: 1 + i * 7 % 23 for i, _, _ in rows}
    by = defaultdict(list)
    for i, _, s in rows:
        by[s].append(i)
    goal = brute_targets({s: sum(size[i] for i in ids) for s, ids in by.items()})
    want = {}
    for s, ids in by.items():
        whole = sum(size[i] for i in ids)
        passes, at = int(goal[s] // whole), 0
        rest = goal[s] - passes * whole
        for i in sorted(ids, key=h.get):
            want[i] = passes + (at + size[i] / 2 <= rest)
            at += size[i]
    plan = m.plan_mix(df, shard_words=500).collect()
    assert {r.doc_id: r.copies for r in plan} == want
    assert len({x for r in plan for x in r.shards}) == 16
    words = defaultdict(int)
    for r in plan:
        for x in r.shards:
            words[x] += r.size
    assert max(words.values()) < 3 * sum(words.values()) / 16
    mixed = defaultdict(int)
    for r in m.mix_documents(df, shard_words=500).collect():
        mixed[r.doc_id] += 1
    assert mixed == {i: n for i, n in want.items() if n}


def test_repeated_and_null_ids(spark):
    rows = [(i % 300, f"t{i} " + "w " * (i % 9), "ab"[i % 2 == 0 or i < 300]) for i in range(900)] + [(None, f"n{i} x y", "none") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = m.plan_mix(df).collect()
    taken, target = defaultdict(int), {}
    for r in plan:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 10 for s in target)
    mixed = defaultdict(int)
    for r in m.mix_documents(df).collect():
        mixed[r.source] += len(r.text.split())
    assert mixed == {s: n for s, n in taken.items() if n}


def test_defined_cases(spark):
    rows = [(i, "w " * (i % 7), ["a", "b", None][i % 3]) for i in range(200)] + [(500, None, "a"), (501, "", "zero"), (7, "w " * 0, "b")] + [(900, "x y z", "hot")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS block", "2 AS copies")
    plan = m.plan_mix(df).collect()
    assert len(plan) == len(rows)
    assert all(r.copies <= 2 and len(r.shards) == r.copies for r in plan)
    mixed = m.mix_documents(df).collect()
    want = sum(r.copies for r in plan if r.doc_id != 900) + 300 * max(r.copies for r in plan if r.doc_id == 900)
    assert len(mixed) == want and mixed[0].asDict().keys() == {"doc_id", "text", "source", "block", "copies"}
    assert m.plan_mix(df.limit(0)).count() == 0


def test_splitting_tree_is_exact(spark, monkeypatch):
    quota = spark.createDataFrame([("a", 128), ("b", 128), (None, 1)], "source string, quota long")
    for group in (m.GROUP, 64):
        monkeypatch.setattr(m, "GROUP", group)
        counts, by = defaultdict(int), defaultdict(int)
        for r in m.split(quota, 3, 5).collect():
            counts[r.shard] += r.draw
            by[r.source] += r.draw
        assert by == {"a": 128, "b": 128, None: 1} and sorted(counts) == list(range(8))
        assert group == 64 or set(counts.values()) <= {32, 33}
        assert max(counts.values()) - min(counts.values()) <= 257 // group + 2


def test_draw_is_hypergeometric(spark):
    """The left half's share of a source varies as a draw without replacement does."""
    quota = spark.createDataFrame([("a", 30), ("b", 70)], "source string, quota long")
    left = [sum(r.draw for r in m.split(quota, 1, seed).collect() if r.shard == 0 and r.source == "a") for seed in range(40)]
    mean = sum(left) / 40
    spread = sum((x - mean) ** 2 for x in left) / 39
    assert abs(mean - 15) < 1.5 and 1.5 < spread < 15  # expected 15 and 5.3
