"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every document has a hash of its id and text; the order of the hash is its source's permutation, and the hash's leading
   bits cut that permutation into blocks.
2. Targets: sources by code point (null last) get cycled weights of a budget, by water-filling below a
   multiple of their size. A source is to take its whole permutation `floor(target / size)` times and then the
   permutation's beginning. The place where it stops is found block by block, then in the one block it
   falls into by the next bits, and last among that part's few documents, so no task ever sorts a source.
   What a source takes is its quota: a number of block copies, the last of which may be a part of its block.
3. Splitting tree: the quotas of all sources are the root's. Each level gives half of a node's block copies to its left child, by
   lot over all of them: the numbers by source that go left are a draw from the multivariate hypergeometric distribution, and
   quotas stay exact. The leaves are output shards. More than `GROUP` block copies are split by several such trees, each of
   about that many, so no task holds them all.
4. Each leaf draws its quota of each source from the source's permuted blocks, after those of the leaves before it, so draws
   are disjoint. How often and to which shards a document goes follows from the draws of its block, and so does
   `taken`. Rows are shuffled within the shard by another hash.

The number of shards follows from the words that are taken (`shard_words` each), that of blocks from the number of shards, so
tables of blocks stay far smaller than the corpus and none of them is gathered in one task. Everything is a
DataFrame expression; the narrow table of sizes and hashes is written to the shared folder once, so a lost
executor costs no second reading of the texts. Only sums over sources reach the driver.

Defined cases: null texts have size 0 and are taken with their block; null sources are one source, the last; rows with null ids
are told apart by their texts, and an id in two sources has a place in each; rows that repeat id, text and source
share their hash and are taken alike, so a stop within them is as near as their sizes allow; an empty table gives no rows; a
source of size 0 has target 0. Other columns pass through `mix_documents` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaweave.llm.common import table, written

WORD = r"[^\x20\x09-\x0D]+"
#: Least bits for blocks, and bits of the fine parts of a block.
BLOCK_BITS, FINE_BITS = 8, 12
#: Block copies in one splitting tree.
GROUP = 1 << 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(id_col: str, text_col: str, seed: int) -> Column:
    """A document's place in its source's permutation."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def with_parts(df: DataFrame, bits: int, h: str = "h") -> DataFrame:
    """Adds the parts of the hash: block, fine."""
    return df.withColumn("block", F.shiftrightunsigned(h, 64 - bits)).withColumn("fine", F.shiftrightunsigned(h, 64 - bits - FINE_BITS).bitwiseAND((1 << FINE_BITS) - 1))


def numbered(sources: DataFrame) -> DataFrame:
    """Adds `number`, the place in the order of sources (from 0, null last), without sorting all in one task."""
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged.withColumn("_own", F.row_number().over(W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row for each partition
    before = counts.select(F.col("_part").alias("_p"), (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn("number", F.col("_before") + F.col("_own") - 1).drop("_part", "_p", "_own", "_before")


def targets(ledger: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target, copies (whole passes) and rest (words of the last pass)."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_source = numbered(ledger.groupBy("source").agg(F.sum("size").alias("source_size")))
    by_source = written(by_source.select("source", "source_size", F.get(cycle, F.col("number") % len(weights)).alias("weight")))
    # Water-filling: the level rises as sources reach their cap, until no further one does. Each round is one small sum.
    cap = most * F.col("source_size")
    whole = by_source.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, n_capped = share * (whole[0] or 0), 0
    level = budget / whole[1] if whole[1] else 0.0
    while True:
        capped = F.lit(level) * F.col("weight") > cap
        now = by_source.agg(F.count_if(capped), F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))).first()
        if now[0] == n_capped or not now[2]:
            break
        n_capped, level = now[0], (budget - now[1]) / now[2]
    out = by_source.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap).cast("double"))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return out.withColumn("copies", copies).select("source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"))


def place(parts: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Adds `low`, `high`: a part's words before and through it in its keys' permutation, and `state`: taken, cut or left."""
    w = W.partitionBy(*keys).orderBy(by)
    out = parts.withColumn("high", F.col("low0") + F.sum("size").over(w)).withColumn("low", F.col("high") - F.col("size"))
    return out.withColumn("state", F.when(F.col("rest") <= 0, "left").when(F.col("high") <= F.col("rest"), "taken").when(F.col("low") < F.col("rest"), "cut").otherwise("left"))


def quotas(docs: DataFrame, *, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, most: float, shard_words: int, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """The narrow table of documents (doc_id, source, size, h), the blocks' marks, and the bits of a block.

    marks: source, block, source_size, target, quota (the source's block copies), rank (of the block in its source), blocks (of
    the source), end_fine and end_doc (how far the last, cut block copy goes; null if it is whole).
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), permuted(id_col, text_col, seed).alias("h"))
    narrow = written(narrow)
    words = share * (narrow.agg(F.sum("size")).first()[0] or 0)
    bits = min(24, max(BLOCK_BITS, shards_log2(words, shard_words) + 2))
    base = with_parts(narrow, bits)
    ledger = base.groupBy("source", "block").agg(F.sum("size").alias("size"))
    goal = targets(ledger, weights, share, most)

    blocks = place(_join(ledger, goal, []).withColumn("low0", F.lit(0).cast("long")), ["source"], "block")
    blocks = written(blocks.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy("block")).cast("long") - 1))
    # The block in which the last pass stops, by its fine parts; then the part in which it stops, by document.
    cut = blocks.where("state = 'cut'").select("source", "block", "low", "rest")
    fine = _join(base, cut, ["block"]).groupBy("source", "block", "fine").agg(F.sum("size").alias("size"), F.first("low").alias("low0"), F.first("rest").alias("rest"))
    fine = place(fine, ["source", "block"], "fine").select("source", "block", "fine", "low", "rest", "state")
    stop = fine.where("state = 'cut'")
    last = _join(base, stop.withColumnRenamed("low", "low0").drop("state"), ["block", "fine"]).groupBy("source", "block", "fine", "h").agg(F.sum("size").alias("size"), F.first("low0").alias("low0"), F.first("rest").alias("rest"))
    last = place(last, ["source", "block", "fine"], "h").where(F.col("low") + F.col("size") / 2 <= F.col("rest"))
    # The hash up to which (included) a cut block is taken.
    ends = last.groupBy("source", "block").agg(F.max(_unsigned("h")).alias("end_doc"))
    whole = fine.where("state = 'taken'").groupBy("source", "block").agg(F.max("fine").alias("end_fine"))
    marks = _join(_join(blocks, whole, ["block"], "left"), ends, ["block"], "left")
    quota = marks.groupBy("source").agg((F.first("copies") * F.count(F.lit(1)) + F.count_if(F.col("state") != "left")).alias("quota"), F.count(F.lit(1)).alias("blocks"))
    marks = _join(marks, quota, [])
    return base, written(marks.select("source", "block", "source_size", "target", "quota", "rank", "blocks", (F.col("state") == "cut").alias("is_cut"), "end_fine", "end_doc")), bits


def shards_log2(words: float, shard_words: int) -> int:
    return max(0, math.ceil(math.log2(max(1.0, words / shard_words))))


def split(quota: DataFrame, levels: int, seed: int) -> DataFrame:
    """The splitting tree over quotas (source, quota): source, shard, draw (the shard's quota of the source)."""
    copies = quota.select("source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))).alias("copy"))
    copies = written(copies)
    groups = max(1, -(-copies.count() // GROUP))
    node = copies.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "source", F.shiftright("copy", 6)), F.lit(groups))).withColumn("node", F.lit(0))
    for level in range(levels):
        lot = F.xxhash64(F.lit(seed + 1 + level), "source", "copy")
        w = W.partitionBy("group", "node").orderBy(lot, F.col("source"), "copy")
        size = F.count(F.lit(1)).over(W.partitionBy("group", "node"))
        node = node.withColumn("node", F.col("node") * 2 + (F.row_number().over(w) * 2 > size + 1).cast("int"))
    return node.groupBy("source", F.col("node").alias("shard")).agg(F.count(F.lit(1)).alias("draw"))


def drawn_blocks(marks: DataFrame, levels: int, seed: int) -> DataFrame:
    """The marks with `shards`: the shard of each of a block's copies, in order of passes.

    Leaves draw their quotas from a source's permuted blocks one after the other, pass after pass.
    """
    leaves = written(split(marks.where("quota > 0").select("source", "quota").distinct(), levels, seed))
    through = F.sum("draw").over(W.partitionBy("source").orderBy("shard"))
    places = leaves.withColumn("end", through).select("source", "shard", F.explode(F.sequence(F.col("end") - F.col("draw"), F.col("end") - 1)).alias("at"))
    sizes = marks.select("source", "blocks").distinct()
    places = _join(places, sizes, []).select("source", "shard", (F.col("at") % F.col("blocks")).alias("rank"), F.floor(F.col("at") / F.col("blocks")).alias("pass"))
    of_block = places.groupBy("source", "rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards"))
    out = _join(marks, of_block, ["rank"], "left").withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))
    return written(out.select("source", "block", "source_size", "target", "is_cut", "end_fine", "end_doc", "shards"))


def drawn(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows (source, block, fine, h) with their block's marks and `shards`: that of each of their own copies."""
    met = _join(rows, marks, ["block"])
    # A cut block's last copy ends within it.
    through = F.coalesce(F.col("fine") <= F.col("end_fine"), F.lit(False)) | F.coalesce(_unsigned("h") <= F.col("end_doc"), F.lit(False))
    n = F.size("shards") - (F.col("is_cut") & ~through).cast("int")
    return met.withColumn("shards", F.slice("shards", F.lit(1), n))


def _planned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shard_words: int = 1 << 24, seed: int = 17) -> tuple[DataFrame, DataFrame, int]:
    base, marks, bits = quotas(docs, id_col=id_col, text_col=text_col, source_col=source_col, weights=weights, share=share, most=most, shard_words=shard_words, seed=seed)
    words = base.agg(F.sum("size")).first()[0] or 0
    return base, drawn_blocks(marks, shards_log2(share * words, shard_words), seed), bits


def plan_mix(docs: DataFrame, **options) -> DataFrame:
    """For each row: doc_id, source, size, source_size, target, copies (0 to `most`), taken, shards (one for each copy)."""
    base, marks, _ = _planned(docs, **options)
    out = drawn(base, marks).withColumn("copies", F.size("shards").cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "shards")


def _unsigned(h: str) -> Column:
    """Signed order of this is the unsigned order of h."""
    return F.col(h).bitwiseXOR(F.lit(-(1 << 63)))


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equality join on the source, null equal to null, and `keys`."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in ("source", *keys) else c) for c in right.columns])
    on = F.col("source").eqNullSafe(F.col("_r_source"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(renamed, on, how).drop("_r_source", *[f"_r_{k}" for k in keys])


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **options) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as the mix takes it, dealt to the shards' partitions and shuffled there.

    Each row finds its own block's marks, so the texts are joined with a table of blocks and not with one of documents.
    """
    _, marks, bits = _planned(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(source_col).alias("source"), permuted(id_col, text_col, seed).alias("h"))
    taken = drawn(with_parts(rows, bits), marks).select("_row", "h", F.posexplode("shards").alias("_copy", "_shard"))
    order = F.xxhash64(F.lit(seed + 99), F.col("h"), F.col("_copy"))
    dealt = taken.withColumn("_order", order).repartition("_shard", F.pmod("_order", F.lit(8))).sortWithinPartitions("_shard", "_order")
    return dealt.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))
