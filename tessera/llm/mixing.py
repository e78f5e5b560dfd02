"""Mixing sources to target weights through hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, small, table, text_or_empty, word_count

#: Bits of the hash that one histogram resolves.
STEP_BITS = 12
CELLS = 1 << STEP_BITS
#: Records a boundary bucket should hold at least, so that small sources are refined as a whole.
REGION_ROWS = 2048
#: Histograms that refine the boundary bucket, then those that fill the gap left with smaller records.
REFINE, FILL = 2, 5


def targets(sizes: DataFrame, weights: Sequence[int], budget: float, cap: int) -> DataFrame:
    """Adds ``target`` to one row per source (source, total, rows).

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``budget`` times all sizes; a target stops at ``cap`` times its source's
    total and the excess goes to the others by weight until none is above. In
    closed form the target is min(cap * total, level * weight): with sources by
    cap / weight, level is the largest of (budget - caps before) / (weights
    from here on). One row per source meets in one task, never a document.
    """
    n = len(weights)
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.row_number().over(by_name) - 1) % n + 1))
    named = named.withColumn("most", F.col("total") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    caps_before = F.sum("most").over(upto) - F.col("most")
    weights_left = F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")
    share = (F.sum("total").over(everything) * F.lit(float(budget)) - caps_before) / weights_left
    levelled = named.withColumn("share", share).withColumn("level", F.max("share").over(everything))
    return levelled.select("source", "total", "rows", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _cell(step: int) -> Column:
    """Bits of the hash after the boundary bucket's prefix: the cell at refinement ``step``."""
    return F.shiftrightunsigned(F.shiftleft(F.expr("shiftleft(h, bits)"), STEP_BITS * step), 64 - STEP_BITS)


def _prefix() -> Column:
    return F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(h, 64 - greatest(bits, 1))"))


def _in_boundary(step: int) -> Column:
    out = F.lit(True)
    for k in range(min(step, REFINE)):
        out = out & (_cell(k) == F.col(f"cut{k}"))
    return out


def _candidate(step: int) -> Column:
    """Rows of the boundary bucket that histogram ``step`` is about."""
    if step < REFINE:
        return _in_boundary(step)
    return ~_chosen(step) & (F.col("size") <= F.col(f"gap{step}"))


def _chosen(steps: int) -> Column:
    out = F.lit(False)
    for k in range(steps):
        if k < REFINE:
            out = out | (_in_boundary(k) & (_cell(k) < F.col(f"cut{k}")))
        else:
            out = out | ((F.col("size") <= F.col(f"gap{k}")) & (_cell(0) < F.col(f"cut{k}")))
    return out


def _cut(cells: DataFrame, at: str, budget: str) -> DataFrame:
    """For each source: the first cell whose running sum exceeds the budget, and the sum before it."""
    run = Window.partitionBy("source").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cells.withColumn("run", F.sum("tokens").over(run))
    over = F.col("run") > F.col(budget)
    return summed.groupBy("source").agg(
        F.min(F.when(over, F.col(at))).alias("cut"), F.coalesce(F.max(F.when(~over, F.col("run"))), F.lit(0)).cast("long").alias("before"),
    )


def _join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def plan_mix(rows: DataFrame, weights: Sequence[int] = (3, 1, 2), budget: float = 1.5, cap: int = 2) -> DataFrame:
    """Thresholds of a mix: one row per source with its total, target, whole copies and cuts.

    ``rows`` has source, size and h (a 64-bit hash), and should be a staged
    table, as it is read three times. Every source's hash range is cut into
    buckets; a histogram of tokens by bucket gives the bucket in which the
    budget ends, only that bucket's records are looked at again, on finer bits,
    and what is then missing is filled by records small enough for the gap.
    """
    work = Workspace(rows.sparkSession, "mixing")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("rows"))
    goal = targets(sizes, weights, budget, cap)
    copies = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("long")
    goal = goal.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("total"))
    bits = F.greatest(F.lit(0), F.least(F.lit(STEP_BITS), F.floor(F.log2(F.greatest(F.col("rows"), F.lit(1)) / REGION_ROWS)))).cast("int")
    goal = work.stage(goal.withColumn("bits", bits), "targets")

    fine = rows.groupBy("source", F.shiftrightunsigned("h", 64 - STEP_BITS).alias("b")).agg(F.sum("size").alias("tokens"))
    coarse = _join(fine, goal, "inner").withColumn("prefix", F.expr(f"shiftright(b, {STEP_BITS} - bits)"))
    coarse = coarse.groupBy("source", "prefix", "rest").agg(F.sum("tokens").alias("tokens"))
    plan = _join(goal, _cut(coarse, "prefix", "rest"))
    plan = plan.withColumn("prefix", F.coalesce("cut", F.expr("shiftleft(1L, bits)"))).withColumn("gap0", F.col("rest") - F.coalesce("before", F.lit(0)))
    plan = work.stage(plan.drop("cut", "before"), "buckets")

    boundary = _join(rows.select("source", "size", "h"), plan.select("source", "bits", "prefix"), "inner").where(_prefix() == F.col("prefix"))
    boundary = work.stage(boundary.select("source", "size", "h"), "boundary")
    for k in range(REFINE + FILL):
        known = _join(boundary, plan, "inner").where(_candidate(k))
        at = _cell(k) if k < REFINE else _cell(0)
        cells = known.groupBy("source", at.alias("cell"), f"gap{k}").agg(F.sum("size").alias("tokens"))
        plan = _join(plan, _cut(cells, "cell", f"gap{k}"))
        plan = plan.withColumn(f"cut{k}", F.coalesce("cut", F.lit(CELLS).cast("long"))).withColumn(f"gap{k + 1}", F.col(f"gap{k}") - F.coalesce("before", F.lit(0)))
        plan = work.stage(plan.drop("cut", "before"), f"plan{k}")
    return plan


def apply_mix(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with source, size and h) and ``times``: how often the mix takes each, 0 to cap."""
    chosen = (_prefix() < F.col("prefix")) | ((_prefix() == F.col("prefix")) & _chosen(REFINE + FILL))
    out = _join(rows, plan)
    return out.withColumn("times", F.col("copies") + F.when(chosen, 1).otherwise(0))


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """(id, source, size) of every row, and the columns ``keep`` as a struct ``row``."""
    size = word_count(text_or_empty("text"))
    extra = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), *extra)
    return base.select("id", "source", size.alias("size"), *(["row"] if keep else []))


def _hashed(rows: DataFrame, copy: Column) -> DataFrame:
    return rows.withColumn("h", F.xxhash64("id", "size", "source", copy.cast("long")))


def numbered_rows(docs: DataFrame, **cols: str) -> DataFrame:
    """(id, source, size, n, h): rows that agree in the first three are counted, and each copy has a hash of its own."""
    tied = keyed_rows(docs, **cols).groupBy("id", "source", "size").agg(F.count("*").alias("n"))
    each = tied.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    return _hashed(each, F.col("copy")).drop("copy")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), budget: float = 1.5, cap: int = 2, **cols: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken.

    size counts words (null text: 0); null is a source like any other and comes
    last. A record is taken as often as whole copies of its source fit the
    target, once more if its hash lies below the cut. Rows that agree in id,
    size and source are told apart by a number, so that a part of them can be
    taken; which of them makes no difference. Sources without words
    have target 0. Other columns are ignored; an empty table gives no rows.
    """
    rows = Workspace(docs.sparkSession, "mix").stage(numbered_rows(docs, **cols), "rows")
    out = apply_mix(rows, plan_mix(rows, weights, budget, cap))
    return out.select(F.col("id").alias("doc_id"), "size", F.col("total").alias("source_size"), "target", (F.col("times") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), budget: float = 1.5, cap: int = 2) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it.

    Of rows that agree in id, size and source, as many are taken as ``mix``
    says, those first whose columns have the lowest hash; rows that agree in all columns are one row several times.
    """
    work = Workspace(docs.sparkSession, "mix")
    rows = work.stage(numbered_rows(docs), "rows")
    plan = plan_mix(rows, weights, budget, cap)
    tied = apply_mix(rows.where("n > 1"), plan).groupBy("id", "source", "size").agg(F.sum(F.col("times") - F.col("copies")).alias("more"))
    tied = work.stage(_hashed(tied, F.lit(0)).select(F.col("h").alias("tied"), "more"), "tied")
    every = _hashed(keyed_rows(docs, keep=docs.columns), F.lit(0))
    alone = apply_mix(every.join(small(tied.drop("more")), F.col("h") == F.col("tied"), "left_anti"), plan).select("row", "times")
    if not tied.isEmpty():
        # Equal rows are combined before they meet, so a row that is there a million times is one row from each task.
        equal = every.join(small(tied), F.col("h") == F.col("tied")).groupBy("source", "h", "more", F.xxhash64("row").alias("mark")).agg(F.count("*").alias("n"), F.first("row").alias("row"))
        before = F.sum("n").over(Window.partitionBy("h").orderBy("mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        equal = _join(equal.withColumn("before", before), plan.select("source", "copies"), "inner")
        some = F.greatest(F.lit(0), F.least(F.col("n"), F.col("more") - F.col("before")))
        alone = alone.unionByName(equal.select("row", (F.col("n") * F.col("copies") + some).alias("times")))
    return alone.where("times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")).select("row.*")


def op2_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
