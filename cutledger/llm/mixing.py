"""Mix sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the words its source has queued up to and including it, in a fixed shuffled order,
divided by the source's target. Copies are taken in order of finish time until the budget is used up. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutledger.llm.common import stored, text_of, unused, word_count

#: Weights of the sources in code-point order, and how often a document may be taken.
WEIGHTS = (5, 2, 1)
COPIES = 3
#: Steps of finish time per unit in the first histogram, its last step, and the refinement of the second.
STEP, LAST, FINER = 1024, 4 * 1024, 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES) -> DataFrame:
    """(source, source_size, target, budget) from rows (source, size). Sources in code-point order, null last, weigh `weights` in turn.

    The budget is the sum of all sizes. No target is above `copies` times its source's size; what is cut off goes to the others by weight
    until none is above. In closed form: with sources by bound/weight ascending, the level is the first one that does not pass its own
    bound. One row per source takes part in the windows.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = total.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.select(
        "*", F.element_at(turn, (F.col("at") % len(weights) + 1).cast("int")).alias("weight"), (F.col("source_size") * copies).alias("bound")
    ).withColumn("ratio", F.col("bound") / F.col("weight"))
    order, whole = Window.orderBy("ratio", "at"), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.select(
        "*",
        F.sum("source_size").over(whole).alias("budget"),
        F.coalesce(F.sum("bound").over(before), F.lit(0)).alias("full"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("spent"),
        F.sum("weight").over(whole).alias("all_weight"),
    ).withColumn("level", (F.col("budget") - F.col("full")) / (F.col("all_weight") - F.col("spent")))
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "at", "level"))
    levels = levels.withColumn("final", F.min(fits).over(whole)["level"])
    return levels.select("source", "source_size", F.least(F.col("bound").cast("double"), F.col("final") * F.col("weight")).alias("target"), "budget")


def _queued(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """Rows with their source's target and the words queued before and with them. A source's queue is scanned in blocks of the shuffle key."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text_of(text)).alias("size"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("shuffle"),
    )
    rows = stored(rows, "mix-sizes")
    targets = source_targets(rows).withColumnRenamed("source", "__source")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.withColumn("block", F.substring("shuffle", 1, 3)).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    inside = Window.partitionBy("key", "block").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy("key", "block").agg(F.sum("size").alias("own"))
    carried = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("key", "block", F.coalesce(F.sum("own").over(carried), F.lit(0)).alias("carry"))
    scanned = rows.withColumn("within", F.sum("size").over(inside)).join(blocks, ["key", "block"])
    return scanned.select("doc_id", "source", "size", "source_size", "target", "budget", "shuffle", (F.col("carry") + F.col("within")).alias("queued"))


def _finish(turn: Column | int) -> Column:
    return (F.col("source_size") * turn + F.col("queued")) / F.col("target")


def _crossing(copies: DataFrame, step: Column) -> DataFrame:
    """(step, before): the step of finish time in which the budget is used up, and the words in earlier steps and earlier rounds."""
    steps = copies.groupBy(step.alias("step")).agg(F.sum("size").alias("own"), F.max("budget").alias("budget"), F.max("before").alias("base"))
    until = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("before", F.col("base") + F.coalesce(F.sum("own").over(until), F.lit(0)))
    last = F.max(F.when(F.col("before") <= F.col("budget"), F.struct("step", "before")))
    return steps.agg(last.alias("last")).select(F.lit(1).alias("one"), "last.step", "last.before")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), turns (copies taken). Other columns are ignored.

    Null and empty texts have size 0 and are never taken. Repeated rows queue one after the other. The shuffled order is the digest of the
    id, so reruns agree. The place where the budget ends is found by two histograms of fixed size and one scan of a thin slice, never by a
    sort of all copies in one task.
    """
    rows = stored(_queued(docs, doc_id, text, source), "mix-queue")
    turns = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))
    copies = rows.filter((F.col("size") > 0) & (F.col("target") > 0)).select("*", turns.alias("turn"), F.lit(0).cast("long").alias("before"))
    copies = copies.withColumn("finish", _finish(F.col("turn")))
    coarse = F.least(F.floor(F.col("finish") * STEP), F.lit(LAST))
    first = _crossing(copies, coarse)
    slice_ = copies.drop("before").withColumn("one", F.lit(1)).join(first, "one").filter(coarse == F.col("step"))
    fine = F.floor((F.col("finish") * STEP - coarse) * FINER)
    second = _crossing(slice_, fine).withColumnsRenamed({"step": "fine", "before": "sure"})
    thin = slice_.join(second, "one").filter(fine == F.col("fine"))
    order = Window.orderBy("finish", "shuffle", "doc_id", "turn").rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct("finish", "shuffle", "doc_id", "turn")
    # the first copy that no longer fits; it exists, as all copies together are COPIES times the budget
    end = thin.withColumn("upto", F.col("sure") + F.sum("size").over(order)).filter(F.col("upto") > F.col("budget")).agg(F.min(place).alias("end"))
    end = end.select(F.lit(1).alias("one"), "end")
    taken = sum(
        (
            F.when(F.struct(_finish(t).alias("finish"), F.col("shuffle"), F.col("doc_id"), F.lit(t).alias("turn")) < F.col("end"), 1).otherwise(0)
            for t in range(COPIES)
        ),
        F.lit(0),
    )
    counted = F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(0)
    out = rows.withColumn("one", F.lit(1)).join(end, "one", "left").withColumn("turns", counted)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("turns")).alias("taken"), "turns")


def take(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mixture with the columns of `docs`, each as often as it is taken.

    Rows find their turn by id, source and size; rows that repeat all three are told apart by a number in the order of a hash of the text.
    """
    names = [F.col(f"`{n}`") for n in docs.columns]
    keys = [unused(docs, n) for n in ("id", "source", "size", "nth")]
    others = [unused(docs, f"their_{n}") for n in ("id", "source", "size", "nth")]
    times, turn = unused(docs, "times"), unused(docs, "turn")
    nth = lambda of, *order: F.row_number().over(Window.partitionBy(*of).orderBy(*order))
    turns = mix(docs, doc_id, text, source).select(*[F.col(c).alias(o) for c, o in zip(("doc_id", "source", "size"), others)], F.col("turns").alias(times))
    turns = turns.withColumn(others[3], nth(others[:3], F.col(times).desc()))
    rows = docs.withColumns({keys[0]: F.col(doc_id), keys[1]: F.col(source), keys[2]: word_count(text_of(text))})
    rows = rows.withColumn(keys[3], nth(keys[:3], F.xxhash64(F.col(text))))
    met = rows.join(turns, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, others)]).filter(F.col(times) > 0)
    return met.select(*names, F.explode(F.sequence(F.lit(1), F.col(times))).alias(turn)).select(*names)


OP8_SQL = """
with rows_ as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '')) as shuffle from documents),
tot as (select source, cast(sum(size) as bigint) as source_size from rows_ group by source),
rk as (select *, row_number() over (order by source nulls last) - 1 as pos from tot),
wt as (select *, [5, 2, 1][cast(pos % 3 + 1 as int)] as weight, source_size * 3 as bound from rk),
rt as (select *, cast(bound as double) / weight as ratio from wt),
lv as (select *, cast(sum(source_size) over () as bigint) as budget,
         cast(sum(source_size) over () - coalesce(sum(bound) over (order by ratio, pos rows between unbounded preceding and 1 preceding), 0) as double)
         / cast(sum(weight) over () - coalesce(sum(weight) over (order by ratio, pos rows between unbounded preceding and 1 preceding), 0) as double) as level from rt),
tg as (select source, source_size, budget, least(cast(bound as double),
         (select arg_min(level, (ratio, pos)) from lv where level <= ratio) * weight) as target from lv),
q as (select r.*, t.source_size, t.target, t.budget,
        cast(sum(size) over (partition by r.source order by shuffle, doc_id, size rows unbounded preceding) as bigint) as queued
      from rows_ r join tg t on r.source is not distinct from t.source),
cp as (select q.*, turn, cast(source_size * turn + queued as double) / target as finish from q, range(3) g(turn) where size > 0 and target > 0),
cu as (select *, sum(size) over (order by finish, shuffle, doc_id, turn rows unbounded preceding) as upto from cp),
tk as (select doc_id, cast(sum(size) as bigint) as taken from cu where upto <= budget group by doc_id)
select q.doc_id, q.size, q.source_size, q.target, cast(coalesce(tk.taken, 0) as bigint) as taken from q left join tk using (doc_id)
"""
