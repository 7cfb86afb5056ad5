import hashlib
import re
import zlib

import numpy as np

from deltaweave.llm import langid_crf, pii_semicrf, toxicity_wfst
from pyspark.sql import functions as F


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_langid_accuracy_and_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid_crf.train(docs)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 !?"), (-4, "the " * 30_000), (-4, "the " * 30_000)], "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("_id", F.lit(2))
    got = {r.doc_id: r for r in langid_crf.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (-1, -2, -3, -4)] == ["und", "und", "und", "en"] and got[-1].score == 0
    assert langid_crf.identify(odd.limit(0), model).count() == 0
    rows = langid_crf.identify(docs, model, keep=["lang", "text"]).collect()
    own = [r for r in rows if held(r.doc_id)]
    assert np.mean([r.lang == r.lang_pred for r in own]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_code_switching_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid_crf.train(docs)
    texts = {r.lang: r.text for r in docs.where("n_chars between 400 and 3000 and doc_id < 60").collect()}
    a, b = texts["en"].lower().split()[:40], texts["de"].lower().split()[:20]
    words = langid_crf.WORDS.findall(" ".join(a + b))
    sums = model.posterior_sums([words])[0]
    en, de = model.labels.index("en"), model.labels.index("de")
    assert abs(sums[en] - 40) < 6 and abs(sums[de] - 20) < 6


def test_posteriors_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    moves, first, emit = rng.random((3, 3)), rng.random(3), rng.random((700, 3))
    begins = np.zeros(700, bool)
    cuts = [0, 1, 5, 128, 300, 640]
    begins[cuts] = True
    got = langid_crf.posteriors(emit, begins, moves, first)
    for lo, hi in zip(cuts, cuts[1:] + [700]):
        e = emit[lo:hi]
        fore = [first * e[0]]
        for x in e[1:]:
            fore.append(fore[-1] @ moves * x)
            fore[-1] /= fore[-1].sum()
        back = [np.ones(3)]
        for x in e[:0:-1]:
            back.append(moves @ (x * back[-1]))
            back[-1] /= back[-1].sum()
        want = np.array(fore) * np.array(back[::-1])
        assert np.allclose(got[lo:hi], want / want.sum(1, keepdims=True))


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(re.fullmatch("0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])", p) for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def test_base_spans_equal_patterns(spark, sf):
    odd = ["a@b.c@d.e", "@a.b", "..@-.-", "1.2.3.4.5.6.7.8", "300.1.1.1", "4539 1488 0343 6467", "+1 (415) 555-2671", "+1 2", "x@y", "4" * 5000, "a@" * 3000, "0" * 5000 + ".1.2.3", "9" * 5000 + ".1.2.3", "1.2.3." + "0" * 4400 + "256", "1.2." + "0" * 4400 + "255.0"]
    texts = odd + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in texts:
        assert sorted(pii_semicrf.base_spans(t)) == sorted((pii_semicrf.KINDS.index(k), s, e) for k, s, e in plain_spans(t))


def test_spelled_out_and_long_segments(spark, sf):
    model = pii_semicrf.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    for text in ("write to john.miller at example dot com soon", "mail first.last [at] mail.host [dot] com now", "see anna.b [At] firma.de", "mail: jo (at) some-host.org"):
        assert any(k == pii_semicrf.EMAIL and not base for k, *_, base in model.spans(text)), text
    for text in ("we met at noon and left", "look at him, then at her", "at dot", " at ", "he was at home. Then he slept"):
        assert model.spans(text) == [], text
    long = "x" * 3000 + "7" + "y" * 3000
    zones = list(pii_semicrf.zones("a " + long + " b " + long + " c", []))
    assert zones == sorted(zones) and all(e <= s for (_, e), (s, _) in zip(zones, zones[1:]))
    model.spans("7a" * 20_000)


def test_pii_query(spark, sf):
    got = {r.doc_id: r for r in pii_semicrf.op5_pii_semicrf(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base = sorted(plain_spans(d.text), key=lambda s: (pii_semicrf.KINDS.index(s[0]), s[1]))
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        r = got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii_semicrf.KINDS]
        assert set(text.split(",")) <= set(r.spans.split(","))


def test_semicrf_adds_and_leaves_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    model = pii_semicrf.train(docs)
    found = lambda t: [(pii_semicrf.KINDS[k], t[s:e]) for k, s, e, base in model.spans(t) if not base]
    assert ("phone", "(415) 555-2671") in found("ring (415) 555-2671 now")
    for clean in ("version 3 of 2024", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "", "pages 12-14, 1999"):
        assert found(clean) == []
    assert model.spans(None) == []
    df = spark.createDataFrame([(1, None), (2, "a@b.c +1 415 555 2671"), (2, "a@b.c +1 415 555 2671")], "doc_id long, text string").withColumn("spans", F.lit(0))
    rows = pii_semicrf.find(df, model, masked=True).collect()
    assert sorted((r.doc_id, r.masked_text) for r in rows if r.masked_text) == [(2, "[EMAIL] [PHONE]")] * 2
    assert pii_semicrf.find(df.limit(0), model).count() == 0


def test_semicrf_sums_equal_enumeration():
    model = pii_semicrf.SemiCrf({"phone": 0.3, "phone n7": 0.7, "card luhn True": 1.0, "ip": -0.2})
    bounds, segments = model.scored("1234567 7654321 x 1.2.3.4")
    n = len(bounds) - 1

    def total(t):
        return 1.0 if t == n else total(t + 1) + sum(np.exp(s[3]) * total(s[2]) for s in segments if s[1] == t)

    fore, back = model.sums(n, segments)
    assert np.isclose(np.exp(fore[n]), total(0)) and np.isclose(fore[n], back[0])


def test_toxicity(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    model = toxicity_wfst.train(docs, labels)
    got = {r.doc_id: r for r in toxicity_wfst.score(docs, model).collect()}
    own = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if held(r.doc_id)]
    y, p = np.array(own).T
    assert (y[p == 1] == 1).mean() > 0.85 and (p[y == 1] == 1).mean() > 0.85
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "You idiot. " * 20_000), (None, "x")], "doc_id long, text string").withColumn("score", F.lit("c"))
    rows = toxicity_wfst.score(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert toxicity_wfst.score(odd.limit(0), model).count() == 0
    nothing = toxicity_wfst.train(docs.limit(0), labels.limit(0))
    assert nothing.score("you idiot, you moron") > nothing.score("hello")


def test_grammar_counts_clauses():
    m = toxicity_wfst.Model({"idiot": 4.0}, np.zeros(9))
    names = toxicity_wfst.FEATURES
    f = lambda t: dict(zip(names, np.expm1(m.features(t)[1 : 1 + len(names)]).round().astype(int)))
    assert f("you are an idiot.") == {"insult": 1, "threat": 0, "aimed": 1, "negated": 0, "reported": 0}
    assert f("he is not idiot")["negated"] == 1 and f("she said idiot")["reported"] == 1
    assert f("not here. idiot")["negated"] == 0
    assert f("we will kill you")["threat"] == 1 and f("we will kill you")["aimed"] == 1


def test_composed_machine_equals_separate_ones():
    t = toxicity_wfst
    alone = [t.counter(t.INSULT, "insult"), t.counter(t.THREAT, "threat"), t.window(t.TARGET, "aimed", 4), t.window(t.TARGET, "aimed", 3, backwards=True), t.window(t.NEGATION, "negated", 2), t.window(t.REPORT, "reported", 6)]
    whole = t.grammar()
    rng = np.random.default_rng(8)
    for _ in range(200):
        classes = rng.integers(0, 6, rng.integers(1, 40)).tolist()
        state, total = 0, np.zeros(len(t.FEATURES))
        for c in classes:
            state, x = whole[state, c]
            total += x
        want = np.zeros(len(t.FEATURES))
        for machine in alone:
            state = 0
            for c in classes:
                state, x = machine[state, c]
                want += x
        assert np.array_equal(total, want)


def test_long_clause_is_counted_once():
    m = toxicity_wfst.Model({"idiot": 4.0}, np.zeros(9))
    words = ["word"] * 1000
    for i in (100, 500, 900):
        words[i] = "idiot"
    clause = " ".join(words)
    assert len(clause) > 5000
    got = m.features(f"Before. {clause}, and after it an idiot.")
    assert round(np.expm1(got[1])) == 4 and round(np.expm1(got[-1])) == 4
    assert round(np.expm1(m.features(clause)[1])) == 3
    assert round(np.expm1(m.features("you " + "x " * 2 + "idiot " * 3)[3])) == 2
