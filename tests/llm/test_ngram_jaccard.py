import random
import re
from itertools import combinations

import numpy as np
import pytest

from deltaweave.llm import ngram_jaccard as j
from deltaweave.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    sets = {i: grams(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            o = len(sets[a] & sets[b])
            if den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_equals_brute_force(spark, n, num, den):
    rng = random.Random(n)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for base in range(14):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 4, 9, 12, 30, 90, 300]))]
        if base % 3 == 0:
            words += passage
        for copy in range(9):
            own = edited(rng, words, rng.choice([0, 0, 1, 2, 4, 8]) * len(words) // 60)
            rows.append((len(rows) * 7 % 1009, rng.choice([" ", "\n", "\t "]).join(own).upper() if copy % 2 else " ".join(own)))
    chain = [f"c{i}" for i in range(200)]
    for _ in range(25):  # a long chain of links
        rows.append((5000 - len(rows), " ".join(chain)))
        chain = edited(rng, chain, 2)
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "a\x0bb"), (2006, "x " * 5000), (2007, "É é")]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").selectExpr("*", "1 AS class", "2 AS component_id")
    got = j.link(df, n=n, num=num, den=den).collect()
    assert len(got) == len(rows) + 3
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, n, num, den)
    kept = j.one_of_each(df, n=n, num=num, den=den)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute(rows, n, num, den).values()})


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in j.link(df).collect()} == {(None, None), (1, 1), (2, 1)}
    assert j.link(df.limit(0)).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(1)
    levels = j.Levels(80, 100)
    for _ in range(300):
        size = int(rng.integers(5, 400))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        gone = int(rng.integers(0, max(1, size // 9) + 1))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, int(rng.integers(0, gone + 1))).astype(np.uint64)]))
        o = len(np.intersect1d(a, b))
        if len(b) and 100 * o >= 80 * (len(a) + len(b) - o) and o < max(len(a), len(b)):
            assert np.intersect1d(j.signatures(a, levels), j.signatures(b, levels)).size
            differ = len(a) + len(b) - 2 * o
            assert np.unpackbits((j.sketch(a) ^ j.sketch(b)).view(np.uint8)).sum() <= differ


def test_one_id_on_two_texts(spark):
    near = " ".join(f"w{i}" for i in range(100))
    rows = [(3, near), (5, near + " x"), (5, "something else of its own here"), (5, "something else of its own here"), (None, near)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = j.one_of_each(df, n=5, num=80, den=100).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, near), (3, near), (5, "something else of its own here")])


def test_pivot_with_many_members(spark, monkeypatch):
    monkeypatch.setattr(j, "FAN", 3)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, words, 1))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in j.link(df).collect()} == brute(rows, 3, 90, 100)


def test_partial_overlaps_sum_to_the_whole(spark):
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 120))) for i in range(6)], "doc_id long, text string")
    sets = {r.doc_id: j.ngram_sets([r.text], 1)[0] for r in docs.collect()}
    name = {i: int(np.uint64(j.class_of(s)).astype(np.int64)) for i, s in sets.items()}
    fan = 2
    wanted = spark.createDataFrame([(c, i) for i, c in name.items()], "class long, node long")
    fans = spark.createDataFrame([(c, fan) for c in name.values()], "class long, fan long")
    pairs = spark.createDataFrame([(name[a], name[b], fan, fan) for a, b in combinations(sets, 2)], "class long, class2 long, fan long, fan2 long")
    met = j.partial_overlaps(pairs, j.fragments_of(docs, wanted, 1), fans).collect()
    for a, b in combinations(sets, 2):
        own = [r for r in met if (r["class"], r.class2) == (name[a], name[b])]
        both = np.intersect1d(sets[a], sets[b])
        assert len({r.part for r in own}) == len(own)
        assert {r.part: r.o for r in own if r.o} == dict(zip(*[x.tolist() for x in np.unique((both >> np.uint64(61)).astype(int), return_counts=True)]))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == got[200] == got[100] == 100


def test_slices_of_few_words(spark):
    for text in ("", "a", "a b", "a b c", "a b c d", "a b c d e", "a b c d e f"):
        for n in (1, 2, 3, 5, 9):
            assert [len(x) for x in j.ngram_sets([text], n)] == [len(grams(text, n))], (text, n)
            assert np.array_equal(j.ngram_sets([text], n)[0], j.ngram_sets([text, "x y z " * 9], n)[0])
    for text in ("a b", "a b c"):  # one document in all, as a task's last slice may hold
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert [tuple(r) for r in j.link(df, n=5, num=80, den=100).collect()] == [(1, 1, 1)]


def test_components_go_on_until_settled(spark, monkeypatch):
    monkeypatch.setitem(components.__globals__, "range", lambda *_: [0])  # no number of rounds may end them
    links = [(i, i + 1) for i in range(40)]
    assert {r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == {0}
