"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes, and fragments are ranges of it. They are used three times:

*Candidates.* Sets whose Jaccard similarity is t or more differ in at most d = (1 - t) / (1 + t) * (sum of sizes) n-grams. With
more than d fragments at least one is equal in both, so each set sends one signature for each fragment, and pairs meet in an
equality join on it. The number of fragments depends on a size level; a set takes part in its own level and in those of the larger
sets it could link to. An empty fragment sends a signature only if a set has so few non-empty ones that it is needed.

*Bounds.* A set's sizes in `FINE` fragments bound a pair's overlap from above by the sum of the smaller ones; pairs below the threshold go.

*Counts.* Each set of a pair that is left is cut into `PARTS` fragments, one row each. Pairs meet both sides' rows in equality joins on (class,
fragment), which carry that fragment's n-grams only; partial overlaps are counted apart and summed for each pair. A class with many pairs
(a pivot) has its rows dealt to one salt for each `FAN` pairs, so no key gathers more than that.

Equal sets are one class before any pair is made. Within a signature's bucket all members are first paired with a few
pivots only (stars); after components of those links are known, members of the bucket in different components are
compared with each other, unless sizes or a parity sketch (whose differing bits never outnumber the differing n-grams) rule them out. So
every link is either found or joins what is already connected, and a group of thousands of near copies costs stars, not all pairs.

Words: A-Z lower-cased, `[^\\x20\\x09-\\x0D]+`. N-grams and classes are compared by 64-bit hashes.

Defined cases: null texts and texts without words have no n-grams and link to nothing; with fewer than n words the whole sequence is
the one n-gram; repeated rows are one class; rows with a null id link to nothing and have a null component; rows that share an id but not
their text are judged each by its text; an empty table gives no rows; columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaweave.llm.common import give_back, release, table, written
from deltaweave.llm.components import components

U64 = np.uint64
SKETCH = 8  # longs
FINE = 256
PARTS = 8
PIVOTS = 4
FAN = 64
#: Rows of two longs, some 40 MB as a hash table.
MOST_BROADCAST = 1_000_000
#: Most bits of the filter of wanted documents: 8 MB, whatever the corpus.
FILTER_BITS = 1 << 26
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, U64) * U64(2) + U64(1)
_BASE, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            x = np.full(size, base, U64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def ngram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Each text's set of n-gram hashes, in their order."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw).translate(_LOWER) + b" ", np.uint8)
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))
    offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
    cuts = np.searchsorted(starts, offsets)
    whole = np.zeros(len(words), U64)
    for j in range(min(n, len(words))):  # the gram that begins at each word; those that run over a text's end are not used
        whole[: len(words) - j] += words[j:] * (_STEP ** U64(j) if j else U64(1))
    grams = mix(whole)
    out = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        elif hi > lo:
            short = words[lo:hi]
            with np.errstate(over="ignore"):
                total_ = sum((short[j] * (_STEP ** U64(j) if j else U64(1)) for j in range(hi - lo)), U64(hi - lo) * _BASE)
            out.append(mix(np.array([total_], U64)))
        else:
            out.append(np.empty(0, U64))
    return out


class Levels:
    """Size levels for similarity num/den: upper sizes, most differing n-grams, fragments."""

    def __init__(self, num: int, den: int, ratio: float = 1.45):
        self.num, self.den, self.ratio = num, den, ratio
        self.top: list[int] = []
        self.differ: list[int] = []
        self.parts: list[int] = []
        self._grow(1000)

    def _grow(self, size: int) -> None:
        while not self.top or self.top[-1] < size:
            top = max(self.top[-1] + 1, int(self.top[-1] * self.ratio)) if self.top else max(1, (self.den - 1) // (self.den - self.num))
            d = 2 * top * (self.den - self.num) // (self.den + self.num)
            self.top.append(top)
            self.differ.append(d)
            # Some more than d + 1, so that empty fragments are hardly ever needed.
            self.parts.append(d + 1 if d == 0 else d + 3 + d * (self.den - self.num) // (2 * self.den))

    def most_differ(self, size: int) -> int:
        """Most n-grams by which a set can differ from any that it links to: the largest of those is the worst."""
        return (size + size * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def of(self, size: int) -> list[int]:
        """A set's own level and those of larger sets that it could link to."""
        largest = size * self.den // self.num
        self._grow(largest)
        first = next(i for i, t in enumerate(self.top) if size <= t)
        out = [first]
        while self.top[out[-1]] < largest:
            out.append(out[-1] + 1)
        return out


def signatures(grams: np.ndarray, levels: Levels) -> np.ndarray:
    """One for each fragment of each of the set's levels, but levels in which only equal sets link."""
    mixed = np.concatenate([[U64(0)], np.cumsum(mix(grams ^ U64(0xA5A5A5A55A5A5A5A)))])
    high = grams >> U64(32)
    out = []
    for level in levels.of(len(grams)):
        if not levels.differ[level]:
            continue
        parts = levels.parts[level]
        bounds = np.searchsorted((high * U64(parts)) >> U64(32), np.arange(parts + 1).astype(U64))
        sizes = np.diff(bounds)
        own = mix(mixed[bounds[1:]] - mixed[bounds[:-1]] + (np.arange(parts).astype(U64) << U64(20)) + U64(level << 52) + sizes.astype(U64) * _STEP)
        full = sizes > 0
        out.append(own if full.sum() <= min(levels.differ[level], levels.most_differ(len(grams))) else own[full])
    return np.concatenate(out) if out else np.empty(0, U64)


def class_of(grams: np.ndarray) -> int:
    """The set's 64-bit name."""
    return int(mix(np.array([np.add.reduce(mix(grams ^ U64(0x0123456789ABCDEF)), dtype=U64) + U64(len(grams))], U64))[0])


def sketch(grams: np.ndarray) -> np.ndarray:
    """Bit i: the parity of the n-grams whose hash leaves i."""
    odd = np.bincount((grams & U64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[tuple[list, list, list]]:
    """Ids, texts and a third column, about `most` characters at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            part = b.slice(lo, 64)
            ids, texts, others = (part.column(i).to_pylist() for i in range(3))
            at = 0
            while at < len(ids):
                size, end = 0, at
                while end < len(ids) and (end == at or size + len(texts[end] or "") <= most):
                    size += len(texts[end] or "")
                    end += 1
                yield ids[at:end], texts[at:end], others[at:end]
                at = end


def _signed(x) -> np.ndarray:
    return np.asarray(x, U64).view(np.int64)


def classes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, t (the text's hash), n, class, s0.. (the sketch), sizes (of the fine fragments)."""
    names = ["doc_id", "t", "n", "class", *[f"s{i}" for i in range(SKETCH)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, hashes in _batches(batches):
            sets = ngram_sets(texts, n)
            marks = np.array([sketch(s) for s in sets])
            sizes = [np.bincount((s >> U64(56)).astype(np.int64), minlength=FINE) for s in sets]
            fine = pa.array([x.astype(np.int8) if x.max() < 128 else None for x in sizes], pa.list_(pa.int8()))  # none: not bounded
            own = [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(_signed([class_of(s) for s in sets])), *[pa.array(marks[:, i]) for i in range(SKETCH)]]
            yield pa.RecordBatch.from_arrays([*own, fine], [*names, "sizes"])
        give_back()

    return docs.select("doc_id", "text", "t").mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", sizes array<tinyint>")


def sent_signatures(docs: DataFrame, n: int, levels: Levels) -> DataFrame:
    """sig, class; classes seen lately in the same task are not sent again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts, _ in _batches(batches):
            sigs, names, sizes = [], [], []
            if len(seen) > 100_000:
                seen.clear()
            for s in ngram_sets(texts, n):
                if not len(s):
                    continue
                c = class_of(s)
                if c in seen:
                    continue
                seen.add(c)
                own = signatures(s, levels)
                sigs.append(own)
                names.append(c)
                sizes.append(len(own))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(sigs))), pa.array(np.repeat(_signed(names), sizes))], ["sig", "class"])
        give_back()

    return docs.select("doc_id", "text", "t").mapInArrow(run, "sig long, class long")


def fragments_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """class, part, grams: the n-grams of each wanted class (class, node) in each of the `PARTS` ranges.

    A bitmap, sized by the number of wanted documents up to a fixed most, keeps other documents' texts from being cut up. It lets a few
    others through: of other classes, which meet no pair, or of the same class, whose equal rows `verified` counts once.
    """
    spark = docs.sparkSession
    bits = min(FILTER_BITS, max(1 << 16, 1 << (32 * wanted.count()).bit_length()))
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    filled = wanted.select(bit("node").alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[np.asarray(filled["word"])] = np.asarray(filled["bits"])
    sent = spark.sparkContext.broadcast(words)  # at most FILTER_BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value

        def chosen():
            for b in batches:
                at = np.asarray(b.column(2))
                b = b.filter(pa.array((asked[at >> 6] >> (at & 63) & 1).astype(bool)))
                if b.num_rows:
                    yield b

        for _, texts, _ in _batches(chosen()):
            names, parts, grams = [], [], []
            for s in ngram_sets(texts, n):
                if len(s):
                    bounds = np.searchsorted(s, np.arange(1, PARTS).astype(U64) << U64(61))
                    own = [x for x in enumerate(np.split(s, bounds)) if len(x[1])]
                    names += [class_of(s)] * len(own)
                    parts += [p for p, _ in own]
                    grams += [g for _, g in own]
            if names:
                ends = np.cumsum([0] + [len(g) for g in grams]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate(grams))))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(names)), pa.array(parts, pa.int32()), lists], ["class", "part", "grams"])
        give_back()

    asked_of = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", bit("doc_id").alias("bit"))
    return asked_of.mapInArrow(run, "class long, part int, grams array<long>")


def partial_overlaps(pairs: DataFrame, fragments: DataFrame, fans: DataFrame) -> DataFrame:
    """class, class2, part, o: for each pair (class, class2, fan, fan2) the n-grams that both have in each fragment they share.

    fans: class, fan of those classes whose fragments go to more than one salt.
    """
    salted = lambda other, fan: F.pmod(F.xxhash64(other), F.col(fan))
    last = F.coalesce("fan", F.lit(1).cast("long")) - 1
    rows = fragments.join(fans, "class", "left").select("class", "part", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("salt"), "grams")
    asked = pairs.select("class", "class2", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), salted("class2", "fan").alias("salt"), salted("class", "fan2").alias("salt2"))
    one = asked.join(rows, ["class", "part", "salt"])
    other = rows.select(F.col("class").alias("class2"), "part", F.col("salt").alias("salt2"), F.col("grams").alias("grams2"))
    met = one.join(other, ["class2", "part", "salt2"])
    return met.select("class", "class2", "part", F.size(F.array_intersect("grams", "grams2")).cast("long").alias("o"))


def _differ(a: str = "", b: str = "2"):
    """Differing bits of two sketches."""
    return sum((F.bit_count(F.col(f"s{i}{a}").bitwiseXOR(F.col(f"s{i}{b}"))) for i in range(SKETCH)), F.lit(0))


def _placed(known: DataFrame, found: DataFrame) -> DataFrame:
    """class, component; a class without a link is its own."""
    return known.select("class").join(found.withColumnRenamed("node", "_n"), F.col("class") == F.col("_n"), "left").select("class", F.coalesce("component", "class").alias("component"))


def _near(num: int, den: int, a: str = "", b: str = "2"):
    """Sizes and sketches that a pair of similarity num/den may have."""
    n1, n2 = F.col(f"n{a}"), F.col(f"n{b}")
    differ = _differ(a, b)
    return (F.least(n1, n2) * den >= F.greatest(n1, n2) * num) & (differ * (den + num) <= (n1 + n2) * (den - num))


def _possible(pairs: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (class, class2 and other columns) whose fine fragments' sizes allow a link."""
    one = known.select("class", F.col("n").alias("n1"), F.col("sizes").alias("sizes1"))
    two = known.select(F.col("class").alias("class2"), F.col("n").alias("n2"), F.col("sizes").alias("sizes2"))
    most = F.aggregate(F.zip_with("sizes1", "sizes2", lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x.cast("int"))
    enough = most * (den + num) >= (F.col("n1") + F.col("n2")) * num
    return pairs.join(one, "class").join(two, "class2").where(F.coalesce(enough, F.lit(True))).select(*pairs.columns)


def pivots_of(met: DataFrame) -> DataFrame:
    """sig, pivots: the smallest, the largest and some drawn members of each bucket."""
    drawn = [F.min(F.struct(F.xxhash64(F.lit(i), "class"), "class"))["class"] for i in range(PIVOTS - 2)]
    return met.groupBy("sig").agg(F.array_distinct(F.array(F.min("class"), F.max("class"), *drawn)).alias("pivots"))


def verified(pairs: DataFrame, docs: DataFrame, known: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (class, class2) that link, as a, b. known: class, node, n."""
    ends = pairs.select("class").unionAll(pairs.select(F.col("class2").alias("class"))).groupBy("class").agg(F.ceil(F.count(F.lit(1)) / FAN).alias("fan"))
    wanted = written(known.select("class", "node", "n").join(ends, "class"))
    fragments = written(fragments_of(docs, wanted.select("class", "node"), n))
    left = wanted.select("class", F.col("n").alias("n1"), "fan")
    right = wanted.select(F.col("class").alias("class2"), F.col("n").alias("n2"), F.col("fan").alias("fan2"))
    sized = written(pairs.join(left, "class").join(right, "class2"))
    parts = partial_overlaps(sized, fragments, written(wanted.where("fan > 1").select("class", "fan"))).groupBy("class", "class2", "part").agg(F.max("o").alias("o"))
    overlap = parts.groupBy("class", "class2").agg(F.sum("o").alias("o"))
    met = sized.join(overlap, ["class", "class2"])
    return met.where(F.col("o") * den >= (F.col("n1") + F.col("n2") - F.col("o")) * num).select(F.col("class").alias("a"), F.col("class2").alias("b"))


def link(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: documents whose sets of n-grams have a similarity of num / den or more are linked."""
    return linked_texts(docs, **options).drop("t")


def linked_texts(docs: DataFrame, *, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and t, the text's hash."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    levels = Levels(num, den)
    rows = written(classes(base, n))
    marks = [f"s{i}" for i in range(SKETCH)]
    known = written(rows.where("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), *[F.first(m).alias(m) for m in [*marks, "sizes"]]))

    bucket = W.partitionBy("sig")
    met = sent_signatures(base.where("doc_id is not null"), n, levels).withColumn("lo", F.min("class").over(bucket)).withColumn("hi", F.max("class").over(bucket)).where("lo <> hi")
    # Buckets with the same members are one, named by its members.
    same = F.xxhash64(F.bit_xor(F.xxhash64("class")).over(bucket), F.bit_xor(F.xxhash64(F.lit(7), "class")).over(bucket), F.count(F.lit(1)).over(bucket))
    met = written(met.select(same.alias("sig"), "class").distinct())
    release(spark)
    # Partial aggregates find a bucket's pivots, so a hot bucket is not gathered; its rows meet them in a join that can be split.
    stars = met.join(written(pivots_of(met)), "sig").select(F.explode("pivots").alias("class2"), "class").where("class <> class2")
    stars = stars.select(F.least("class", "class2").alias("class"), F.greatest("class", "class2").alias("class2")).distinct()
    second = known.select(F.col("class").alias("class2"), F.col("n").alias("n2"), *[F.col(m).alias(f"{m}2") for m in marks])
    stars = written(stars.join(known.drop("node", "sizes"), "class").join(second, "class2").where(_near(num, den)).select("class", "class2", _differ().alias("differ")))
    stars = written(_possible(stars, known, num, den))
    release(spark)

    # First each class with its nearest pivot only, then those star pairs that still lie in two components.
    ends = stars.unionByName(stars.select(F.col("class2").alias("class"), F.col("class").alias("class2"), "differ"))
    nearest = ends.groupBy("class").agg(F.min_by("class2", F.struct("differ", "class2")).alias("class2"))
    nearest = nearest.select(F.least("class", "class2").alias("class"), F.greatest("class", "class2").alias("class2")).distinct()
    links = written(verified(written(nearest), base, known, n, num, den))
    release(spark)
    where = _placed(known, written(components(links)))
    second = where.select(F.col("class").alias("class2"), F.col("component").alias("component2"))
    apart = stars.join(where, "class").join(second, "class2").where("component <> component2").select("class", "class2")
    links = written(links.unionByName(verified(written(apart.join(nearest, ["class", "class2"], "left_anti")), base, known, n, num, den)))
    release(spark)
    found = written(components(links))

    # Buckets whose members are still in several components: compare those members with each other.
    where = _placed(known, found)
    members = written(met.join(where, "class"))
    split = members.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    members = written(members.join(written(split.select("sig")), "sig", "left_semi"))
    members = members.join(written(pivots_of(members)), "sig").where(~F.array_contains("pivots", F.col("class"))).select("sig", "class", "component")
    open_ = written(members.join(known.drop("node", "sizes"), "class"))
    other = open_.select("sig", *[F.col(c).alias(f"{c}2") for c in open_.columns if c != "sig"])
    rest = open_.join(other, "sig").where((F.col("class") < F.col("class2")) & (F.col("component") != F.col("component2")) & _near(num, den))
    rest = written(_possible(written(rest.select("class", "class2").distinct()), known, num, den))
    more = written(verified(rest, base, known, n, num, den))
    release(spark)
    final = components(links.unionByName(more)) if more.limit(1).count() else found

    placed = written(_placed(known, final).join(known.select("class", "node"), "class"))
    least = placed.groupBy("component").agg(F.min("node").alias("component_id"))
    labelled = placed.join(least, "component").select("class", "component_id")
    out = rows.select("doc_id", "t", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("class")).alias("class"))
    return out.join(labelled, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "t")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, of each group of linked documents only the one with the smallest id, once for each of its texts; rows with a null id stay."""
    linked = linked_texts(docs, id_col=id_col, text_col=text_col, **options)
    # Only the dropped ids are joined. Up to a fixed number of them are broadcast, so that texts stay where they are.
    dropped = written(linked.where("component_id <> doc_id").select(F.col("doc_id").alias("_dropped"), F.col("t").alias("_t")).distinct())
    repeated = linked.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    dropped = F.broadcast(dropped) if dropped.count() <= MOST_BROADCAST else dropped
    hashed = F.xxhash64(docs[text_col])
    out = docs.join(dropped, (docs[id_col] == F.col("_dropped")) & (hashed == F.col("_t")), "left_anti")
    if repeated:
        once = out.where(F.col(id_col).isNotNull()).withColumn("_t", F.xxhash64(text_col)).dropDuplicates([id_col, "_t"]).drop("_t")
        out = once.unionByName(out.where(F.col(id_col).isNull()))
    return out


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
both_ways AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT y, c FROM reach JOIN both_ways ON x = doc_id),
component AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN component ON component.doc_id = d.doc_id
"""
