"""Delta joins: the embeddings that each effective update creates or destroys.

An embedding is an injective map that keeps vertex labels and query edges. An update is matched on its own
snapshot th, once for each anchor; by injectivity anchors never count an embedding twice. Each level of a plan
is an equality join with the versions' lifetimes as a residual condition, so Catalyst picks and adaptive
execution re-plans the physical joins, and equal shuffles of the adjacency are shared between anchors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaweave.functions.scalars import visible
from deltaweave.operators.pruning import relevant_entries
from deltaweave.plans.match_plan import Plan, Statistics, build_plans, set_partitions
from deltaweave.plans.query_graph import QueryGraph


def _entries(adj: DataFrame, q: QueryGraph, check: tuple[int, int, int | None], c: int, tag: str) -> DataFrame:
    p, side, el = check
    e = adj.where((F.col("side") == side) & (F.col("src_label") == q.labels[p]) & (F.col("dst_label") == q.labels[c]))
    if q.labelled:
        e = e.where(F.col("el").eqNullSafe(F.lit(el)))
    return e.select(F.col("src").alias(f"_s{tag}"), F.col("dst").alias(f"_d{tag}"), F.col("ins").alias(f"_i{tag}"), F.col("del").alias(f"_e{tag}"))


def _bind(rows: DataFrame, adj: DataFrame, q: QueryGraph, c: int, checks: list, bound: list[int], out: str | None = None) -> DataFrame:
    """Joins candidates for query vertex c (column `out`) through the first check and closes the others at once."""
    out = out or f"v{c}"
    for n, check in enumerate(checks):
        e = _entries(adj, q, check, c, str(n))
        on = (F.col(f"v{check[0]}") == F.col(f"_s{n}")) & visible(F.col("th"), F.col(f"_i{n}"), F.col(f"_e{n}"))
        if n:
            on = on & (F.col(out) == F.col(f"_d{n}"))
        rows = rows.join(e, on).drop(f"_s{n}", f"_i{n}", f"_e{n}")
        rows = rows.drop(f"_d{n}") if n else rows.withColumnRenamed(f"_d{n}", out)
        if not n:  # different labels imply different vertices
            for b in bound:
                if q.labels[b] == q.labels[c]:
                    rows = rows.where(F.col(out) != F.col(f"v{b}"))
    return rows


def _anchor_rows(eff: DataFrame, adj: DataFrame, q: QueryGraph, plan: Plan) -> DataFrame:
    """Updates as the plan's anchor: u is its first vertex and v its second (undirected queries have both orientations as anchors)."""
    a, b = plan.first, plan.second
    rows = eff.where((F.col("lu") == q.labels[a]) & (F.col("lv") == q.labels[b]))
    if q.labelled:
        rows = rows.where(F.col("el").eqNullSafe(F.lit(plan.label)))
    rows = rows.select("seq", "th", F.col("u").alias(f"v{a}"), F.col("v").alias(f"v{b}"))
    for p, side, el in plan.closing:
        other = a if p == b else b
        e = _entries(adj, q, (p, side, el), other, "c")
        rows = rows.join(e, (F.col(f"v{p}") == F.col("_sc")) & (F.col(f"v{other}") == F.col("_dc")) & visible(F.col("th"), F.col("_ic"), F.col("_ec"))).drop("_sc", "_dc", "_ic", "_ec")
    return rows


def anchored_embeddings(eff: DataFrame, adj: DataFrame, q: QueryGraph, plan: Plan, levels: int | None = None) -> DataFrame:
    """seq, th and v0.. for each embedding (of the first `levels` levels) that the plan's anchor finds."""
    rows, bound = _anchor_rows(eff, adj, q, plan), [plan.first, plan.second]
    for level in plan.levels[:levels]:
        rows = _bind(rows, adj, q, level.vertex, level.checks, bound)
        bound.append(level.vertex)
    return rows


def _counted_tail(eff: DataFrame, adj: DataFrame, q: QueryGraph, plan: Plan) -> DataFrame:
    """Counts with the plan's tail counted by set partitions: the injective assignments of sets C1..Cr number
    sum over partitions of prod over blocks (-1)^(|B|-1) (|B|-1)! |intersection of the block's sets|."""
    head = len(plan.levels) - plan.tail
    rows = anchored_embeddings(eff, adj, q, plan, head)
    bound = plan.order[: 2 + head]
    tail = plan.levels[head:]
    keys = ["seq", *[f"v{b}" for b in bound]]
    checks = {level.vertex: level.checks for level in tail}
    counts: dict[tuple[int, ...], str] = {}
    total: Column = F.lit(0).cast("long")
    for blocks in set_partitions([level.vertex for level in tail]):
        if any(len({q.labels[c] for c in b}) > 1 for b in blocks):
            continue  # no vertex has two labels
        term: Column = F.lit(1).cast("long")
        for b in blocks:
            name = counts.setdefault(tuple(sorted(b)), f"n_{'_'.join(map(str, sorted(b)))}")
            sign = (-1) ** (len(b) - 1) * reduce(lambda x, y: x * y, range(1, len(b)), 1)
            term = term * F.coalesce(F.col(name), F.lit(0)) * sign
        total = total + term
    out = rows
    for block, name in counts.items():
        every = list(dict.fromkeys(x for c in block for x in checks[c]))
        found = _bind(rows, adj, q, block[0], every, bound, out="_w").groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
        # A prefix without candidates for a single vertex has no embeddings at all.
        out = out.join(found, keys, "inner" if len(block) == 1 else "left")
    return out.groupBy("seq").agg(F.sum(total).alias("n"))


def _joint_counts(eff: DataFrame, adj: DataFrame, q: QueryGraph, plans: list[Plan]) -> DataFrame:
    """All anchors in one chain of joins: rows carry their anchor's number, and each level's key, side and labels are
    looked up by it. There are as many joins as one anchor needs, and each shuffles the adjacency once for all.

    A level with several checks expands each row from the end with the fewest entries of the wanted kind (its pivot) and closes
    the others, so a hub is read only where all of a row's ends are hubs; rows with an end that never has such an entry go.
    """
    by = lambda values: F.get(F.array(*[F.lit(x) for x in values]), F.col("a"))

    def join(rows: DataFrame, at: Column, side: Column, el: Column, label: Column, labels: list[int], target: str | None, kept: list[str]) -> DataFrame:
        """Entries of `at` that are visible to the row: with the wanted label as `_new`, or those that lead to `target`."""
        e = adj.where(F.col("dst_label").isin(sorted(set(labels)))).select(*[F.col(c).alias(f"_{c}x") for c in ("src", "side", "dst", "dst_label", "el", "ins", "del")])
        on = (at == F.col("_srcx")) & (F.col("_sidex") == side) & visible(F.col("th"), F.col("_insx"), F.col("_delx"))
        if q.labelled:
            on = on & F.col("_elx").eqNullSafe(el)
        on = on & (F.col("_dstx") == F.col(target) if target else F.col("_dst_labelx") == label)
        return rows.join(e, on).select(*kept, *([] if target else [F.col("_dstx").alias("_new")]))

    names = ["p0", "p1"]
    found = []
    for a, plan in enumerate(plans):
        own = eff.where((F.col("lu") == q.labels[plan.first]) & (F.col("lv") == q.labels[plan.second]))
        if q.labelled:
            own = own.where(F.col("el").eqNullSafe(F.lit(plan.label)))
        found.append(own.select("seq", "th", F.lit(a).alias("a"), F.col("u").alias("p0"), F.col("v").alias("p1")))
    rows = reduce(DataFrame.unionByName, found)
    place = [{v: i for i, v in enumerate(p.order)} for p in plans]
    closing = [p.closing for p in plans]
    if any(closing):  # directed queries with both a -> b and b -> a: every anchor of another edge passes unchecked
        open_ = rows.where(F.col("a").isin([i for i, c in enumerate(closing) if not c]))
        shut = rows.where(F.col("a").isin([i for i, c in enumerate(closing) if c]))
        checks = [c[0] if c else (0, 0, None) for c in closing]
        ends = [q.labels[p.first] for p in plans]
        shut = join(shut, F.col("p1"), by([c[1] for c in checks]), by([c[2] for c in checks]).cast("long"), by(ends), ends, "p0", ["seq", "th", "a", *names])
        rows = open_.unionByName(shut)
    degrees = adj.groupBy(F.col("src").alias("_src"), F.col("side").alias("_side"), F.col("dst_label").alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    for i in range(q.k - 2):
        level = [p.levels[i] for p in plans]
        labels = [q.labels[x.vertex] for x in level]
        most = max(len(x.checks) for x in level)
        # An anchor with fewer checks repeats its first one, which holds exactly once.
        checks = [x.checks + x.checks[:1] * (most - len(x.checks)) for x in level]
        flat = lambda values, j, n=most: F.get(F.array(*[F.lit(x) for x in values]), F.col("a") * n + j)
        position = [place[a][c[0]] for a, own in enumerate(checks) for c in own]
        sides = [c[1] for own in checks for c in own]
        els = [c[2] for own in checks for c in own]
        at = lambda j, p=position, f=flat: F.get(F.array(*[F.col(n) for n in names]), f(p, j))
        kept = ["seq", "th", "a", *names]
        if most > 1:
            for j in range(most):
                d = degrees.withColumnRenamed("_n", f"_n{j}")
                rows = rows.join(d, (at(F.lit(j)) == F.col("_src")) & (flat(sides, F.lit(j)) == F.col("_side")) & (by(labels) == F.col("_label"))).drop("_src", "_side", "_label")
            n = F.array(*[F.col(f"_n{j}") for j in range(most)])
            rows = rows.select(*kept, (F.array_position(n, F.array_min(n)) - 1).cast("int").alias("_pivot"))
            kept.append("_pivot")
        for j in range(most):
            which = F.lit(0) if most == 1 else F.col("_pivot") if not j else F.when(F.col("_pivot") == j, 0).otherwise(j)
            rows = join(rows, at(which), flat(sides, which), flat(els, which).cast("long"), by(labels), labels, "_new" if j else None, [*kept, *(["_new"] if j else [])])
            if not j:
                for n in names:
                    rows = rows.where(F.col("_new") != F.col(n))
        rows = rows.drop("_pivot").withColumnRenamed("_new", f"p{i + 2}")
        names = [*names, f"p{i + 2}"]
    return rows.groupBy("seq").agg(F.sum(by([p.weight for p in plans])).cast("long").alias("n"))


def delta_counts(eff: DataFrame, adj: DataFrame, q: QueryGraph, *, stats: Statistics | None = None, kind: int = 0, merge: bool = True, joint: bool = True, count_tails: bool = False) -> DataFrame:
    """seq, delta for updates with embeddings. eff: labelled effective updates. joint: all anchors in one chain of
    joins; count_tails: a chain for each anchor, with independent last vertices counted instead of enumerated."""
    plans = build_plans(q, stats, kind, merge)
    adj = relevant_entries(adj, q)
    if joint and not count_tails:
        return _joint_counts(eff, adj, q, plans).select("seq", F.col("n").alias("delta")).where("delta > 0")
    parts = []
    for plan in plans:
        if count_tails and plan.tail:
            part = _counted_tail(eff, adj, q, plan)
        else:
            part = anchored_embeddings(eff, adj, q, plan).groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
        parts.append(part.select("seq", (F.col("n") * plan.weight).alias("n")))
    return reduce(DataFrame.unionByName, parts).groupBy("seq").agg(F.sum("n").cast("long").alias("delta")).where("delta > 0")


def delta_matches(updates: DataFrame, eff: DataFrame, adj: DataFrame, q: QueryGraph, **options) -> DataFrame:
    """seq, op, delta for every update, 0 where it changes nothing."""
    found = delta_counts(eff, adj, q, **options)
    return updates.select("seq", "op").join(found, "seq", "left").select("seq", "op", F.coalesce("delta", F.lit(0)).cast("long").alias("delta"))


def static_count(adj: DataFrame, q: QueryGraph, theta: int, stats: Statistics | None = None) -> DataFrame:
    """n_matches: embeddings in the snapshot at theta."""
    plan = build_plans(q, stats, merge=False)[0]
    edges = adj.where("side = 0").where(visible(F.lit(theta), F.col("ins"), F.col("del")))
    as_updates = edges.select(F.lit(0).cast("long").alias("seq"), F.lit(theta).cast("long").alias("th"), F.col("src").alias("u"), F.col("dst").alias("v"), F.col("src_label").alias("lu"), F.col("dst_label").alias("lv"), "el")
    return anchored_embeddings(as_updates, adj, q, plan).agg(F.count(F.lit(1)).alias("n_matches"))


def totals(deltas: DataFrame, eff: DataFrame, updates: DataFrame) -> DataFrame:
    """dm_pos, dm_neg, eff_ins, eff_del, noop in one row."""
    d = deltas.agg(
        F.coalesce(F.sum(F.when(F.col("op") == "I", F.col("delta"))), F.lit(0)).cast("long").alias("dm_pos"),
        F.coalesce(F.sum(F.when(F.col("op") == "D", F.col("delta"))), F.lit(0)).cast("long").alias("dm_neg"),
        F.count_if(F.col("delta") > 0).alias("touched"),
        F.count(F.lit(1)).alias("n"),
    )
    e = eff.agg(F.count_if(F.col("op") == "I").alias("eff_ins"), F.count_if(F.col("op") == "D").alias("eff_del"))
    return d.join(F.broadcast(e)).select("dm_pos", "dm_neg", "eff_ins", "eff_del", (F.col("n") - F.col("eff_ins") - F.col("eff_del")).alias("noop"))
