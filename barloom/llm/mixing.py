"""Mixing sources to target weights: hierarchical budgets over a tree of groups, by DataFrame functions only.

A budget of tokens is split down the tree (for instance domain, language, source). Siblings share their
parent's budget by weight, each up to what its subtree can give: the tokens there times the epochs allowed.
A shortage therefore goes to siblings first and reaches an ancestor's siblings only when the whole family
is used up. Every leaf then takes a prefix of its documents, in a seeded order of each epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import fresh, written

DIGITS = 3  # hex digits of the order key that name a slice of a leaf


def shared_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes: parent columns, name, weight, capacity, budget (of the parent) -> with ``share``.

    share = min(capacity, level * weight) with the level at which siblings use the budget up. Sorted by
    capacity / weight, the siblings that run full are a prefix, so running sums give the level.
    """
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    order = family.orderBy(ratio.asc_nulls_last(), F.col(name).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    level = (F.col("budget") - full) / F.sum("weight").over(rest)
    nodes = nodes.withColumn("t_level", F.when(F.col("weight") > 0, level)).withColumn("t_ratio", ratio)
    # The first sibling whose ratio exceeds its level stops the prefix; its level holds for it and all behind it.
    stop = F.min(F.when(F.col("t_ratio") > F.col("t_level"), F.struct("t_ratio", F.col(name).alias("t_name"), "t_level"))).over(family)["t_level"]
    share = F.when(F.col("weight") > 0, F.least(F.col("capacity"), F.coalesce(stop * F.col("weight"), F.col("capacity")))).otherwise(0.0)
    return nodes.withColumn("share", share).drop("t_level", "t_ratio")


def budgets(leaves: DataFrame, levels: list[str], total: Column, weights: DataFrame | None) -> DataFrame:
    """leaves: level columns and capacity -> with the leaf's budget. weights: level, path (name/name/...), weight.

    What lies below a node without weight can't be drawn, so it counts in ``all`` but in no capacity.
    """
    budget, leaves = None, leaves.withColumn("offered", F.col("capacity"))
    for depth in range(1, len(levels) + 1 if weights is not None else 1):
        shut = weights.where((F.col("level") == depth) & (F.col("weight") <= 0)).select(F.col("path").alias("w_path")).distinct()
        leaves = leaves.withColumn("w", F.concat_ws("/", *(F.coalesce(F.col(c), F.lit("")) for c in levels[:depth])))
        leaves = leaves.join(shut, F.col("w") == F.col("w_path"), "left")
        leaves = leaves.withColumn("capacity", F.when(F.col("w_path").isNull(), F.col("capacity")).otherwise(0.0)).drop("w", "w_path")
    for depth in range(1, len(levels) + 1):
        path, parent = levels[:depth], levels[: depth - 1]
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("offered").alias("offered"))
        label = F.concat_ws("/", *(F.coalesce(F.col(c), F.lit("")) for c in path))
        if weights is None:
            nodes = nodes.withColumn("weight", F.lit(1.0))
        else:
            own = weights.where(F.col("level") == depth).select(F.col("path").alias("w_path"), F.col("weight").cast("double").alias("weight"))
            nodes = nodes.withColumn("w", label).join(own, F.col("w") == F.col("w_path"), "left").drop("w", "w_path")
            nodes = nodes.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        if parent:
            above = budget.select(*(F.col(c).alias(f"b_{c}") for c in parent), "budget")
            on = [nodes[c].eqNullSafe(above[f"b_{c}"]) for c in parent]
            nodes = nodes.join(above, on).drop(*(f"b_{c}" for c in parent))
        else:
            all_of = nodes.agg(F.sum("offered").alias("all"), F.sum("capacity").alias("most"))
            nodes = nodes.crossJoin(all_of.select(F.least(total.cast("double"), F.col("most")).alias("budget")))  # one row
        budget = shared_out(nodes, parent, levels[depth - 1]).select(*path, F.col("share").alias("budget"))
    return budget


def mix(
    docs: DataFrame, levels: list[str], *, part: float = 0.5, epochs: int = 2, weights: DataFrame | None = None, seed: str = "7"
) -> DataFrame:
    """Selects documents so that groups get their weights' share of ``part`` of all tokens.

    docs: doc_id, text and the string columns of ``levels``; all columns come back, with tokens (words
    ``[^\\x20\\x09-\\x0D]+`` of the text) and epoch (from 0): one row for each time that a document is
    taken. A document may be taken ``epochs`` times. weights: rows (level from 1, path such as
    "web/en", weight); a node without one has weight 1, one with weight 0 gets nothing.

    In each epoch a leaf's documents are ordered by md5(seed:epoch:doc_id), then doc_id; the leaf takes
    them until its budget is reached, so it exceeds that by less than its last document. The
    order key's first digits cut a leaf into slices; sums of slices find the slice where the budget
    ends, and only its rows are ranked, so a leaf that holds most rows needs no large task.

    Null level values are a group of their own, null or empty texts have no tokens and are taken with
    the prefix, rows of one doc_id in a leaf are taken or left together, a null doc_id counts as "null". An empty table gives no rows.
    """
    names = {c: fresh(docs, c) for c in ("tokens", "epoch")}
    counted = docs.withColumn(names["tokens"], F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))
    slim = counted.select(
        *(F.col(c).alias(f"v{i}") for i, c in enumerate(levels)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc"),
        F.col(names["tokens"]).alias("tokens"),
    )
    cols = [f"v{i}" for i in range(len(levels))]
    slim = written(slim.groupBy(*cols, "doc").agg(F.sum("tokens").alias("tokens")), "mix-tokens")
    leaves = slim.groupBy(*cols).agg(F.sum("tokens").cast("double").alias("whole")).withColumn("capacity", F.col("whole") * epochs)
    total = F.floor(F.lit(part) * (F.col("all") / epochs))
    plan = written(
        budgets(leaves, cols, total, weights).select(*(F.col(c).alias(f"p{c}") for c in cols), F.floor(F.col("budget") + 1e-6).cast("long").alias("budget")),
        "mix-budgets",
    )
    same = lambda a, b: [a[c].eqNullSafe(b[f"p{c}"]) for c in cols]

    rows = slim.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    rows = rows.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.col("doc"))))
    rows = rows.withColumn("slice", F.substring("h", 1, DIGITS))
    sums = rows.groupBy(*cols, "epoch", "slice").agg(F.sum("tokens").alias("t"))
    upto = Window.partitionBy(*cols).orderBy("epoch", "slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("t").over(upto))
    sums = sums.join(plan, same(sums, plan)).where(F.col("upto") - F.col("t") < F.col("budget")).select(
        *(F.col(c).alias(f"s{c}") for c in cols), F.col("epoch").alias("s_epoch"), F.col("slice").alias("s_slice"),
        (F.col("budget") - F.col("upto") + F.col("t")).alias("room"), (F.col("upto") < F.col("budget")).alias("whole"),
    )
    rows = rows.join(sums, [*(rows[c].eqNullSafe(sums[f"s{c}"]) for c in cols), rows["epoch"] == sums["s_epoch"], rows["slice"] == sums["s_slice"]])
    inside = Window.partitionBy(*cols, "epoch", "slice").orderBy("h", "doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part_rows = rows.where(~F.col("whole")).withColumn("run", F.sum("tokens").over(inside)).where(F.col("run") - F.col("tokens") < F.col("room"))
    taken = rows.where("whole").select(*cols, "doc", "epoch").unionByName(part_rows.select(*cols, "doc", "epoch"))
    taken = taken.select(*(F.col(c).alias(f"k{c}") for c in cols), F.col("doc").alias("k_doc"), F.col("epoch").alias(names["epoch"]))
    on = [counted[c].eqNullSafe(taken[f"k{v}"]) for c, v in zip(levels, cols)]
    on.append(F.coalesce(counted["doc_id"].cast("string"), F.lit("null")) == taken["k_doc"])
    return counted.join(taken, on).select(*(counted[c] for c in counted.columns), taken[names["epoch"]])


def oracle(levels: list[str], table: str, part: float, epochs: int, seed: str, output: str, weights: list[tuple[int, str, float]]) -> str:
    """The same selection as DuckDB SQL over ``table`` (doc_id, text, levels; no null among them); weights as in ``mix``, one at least."""
    label = lambda n: " || '/' || ".join(levels[:n])
    shut = " ".join(f"when {i} then {label(i)}" for i in range(1, len(levels) + 1))
    steps = [
        f"w(level, path, weight) as (values {', '.join(f"({i}, '{path}', cast({weight} as double))" for i, path, weight in weights)})",
        f"d as (select {', '.join(levels)}, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as tokens from {table})",
        f"t as (select *, not exists (select 1 from w where weight <= 0 and path = case level {shut} end) as offered from d)",
        f"b0 as (select least(floor({part} * sum(tokens)), coalesce(sum(tokens) filter (where offered), 0) * {epochs}) as budget from t)",
    ]
    for i in range(1, len(levels) + 1):
        path, parent = levels[:i], levels[: i - 1]
        by = f"partition by {', '.join(parent)}" if parent else ""
        join = "join b%d b on %s" % (i - 1, " and ".join(f"n.{c} = b.{c}" for c in parent) or "true")
        keys = ", ".join(f"n.{c}" for c in path)
        steps += [
            f"g{i} as (select {', '.join(path)}, cast(coalesce(sum(tokens) filter (where offered), 0) * {epochs} as double) as capacity from t group by all)",
            f"n{i} as (select g.*, coalesce(w.weight, 1.0) as weight, case when coalesce(w.weight, 1.0) > 0 then capacity / coalesce(w.weight, 1.0) end as ratio "
            f"from g{i} g left join w on w.level = {i} and w.path = {label(i)})",
            f"l{i} as (select {keys}, n.capacity, n.weight, n.ratio, case when n.weight > 0 then (b.budget - coalesce(sum(n.capacity) over (w rows between unbounded preceding and 1 preceding), 0)) / "
            f"sum(n.weight) over (w rows between current row and unbounded following) end as level from n{i} n {join} "
            f"window w as ({by.replace('by ', 'by n.').replace(', ', ', n.')} order by n.ratio nulls last, n.{path[-1]}))",
            f"b{i} as (select {', '.join(path)}, case when weight > 0 then least(capacity, coalesce(max(level) filter (where ratio > level) over ({by}) * weight, capacity)) else 0 end as budget from l{i})",
        ]
    n, keys = len(levels), ", ".join(levels)
    steps += [
        f"r as (select t.*, e.epoch, md5('{seed}:' || e.epoch || ':' || t.doc_id) as h from t cross join (select unnest(range({epochs})) as epoch) e)",
        f"c as (select r.*, sum(tokens) over (partition by {keys} order by epoch, h, doc_id rows unbounded preceding) as upto from r)",
        f"s as (select c.* from c join b{n} b on {' and '.join(f'c.{x} = b.{x}' for x in levels)} where c.upto - c.tokens < floor(b.budget + 1e-6))",
    ]
    return "with " + ",\n".join(steps) + f"\n{output}"
