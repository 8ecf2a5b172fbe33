"""Interleaving of sources to target weights by Pfair scheduling, in DataFrame functions only."""

from __future__ import annotations

from itertools import chain
from math import isfinite

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Written, bounded, ranked, same, written

#: Whole weights of a schedule sum to about this, so a weight is off by under half of 2**-36.
UNIT = 2**36
#: Blocks of a schedule, at most about: more documents make larger blocks. Then all products below fit in a long, and what the rounding
#: of weights adds over the whole schedule is under a thousandth of a block.
MOST_BLOCKS = 2**25
#: Slots that one row of the plan schedules; more with more sources.
STRETCH = 512

# The schedule to keep to is fluid: at each time the sources that have blocks left share it by weight. x lists a tier's sources with
# n blocks, weight w and `out`, w times the time at which the source's blocks are used up; a source is out by time t if out <= t * w.
#: w times the time at which source a has had j blocks, out or not: the others that ran out before then have had all of theirs.
_TIME = "aggregate(x, 0L, (t, o) -> t + least(o.n * a.w, o.w * ({j})))"
#: The state of the fluid schedule at time t: blocks of sources that are out, weight of those that are not.
_FLUID = "named_struct('gone', aggregate(x, 0L, (t, o) -> t + if(o.out <= {t} * o.w, o.n, 0L)), 'rate', aggregate(x, 0L, (t, o) -> t + if(o.out <= {t} * o.w, 0L, o.w)))"
#: Blocks that source o has had by the time of the state s, rounded down or up.
_DOWN = "if(o.out <= {t} * o.w, o.n, (o.w * ({t} - {s}.gone)) div {s}.rate)"
_UP = "if(o.out <= {t} * o.w, o.n, (o.w * ({t} - {s}.gone) + {s}.rate - 1) div {s}.rate)"

#: Sources that are in the middle of a block at time `at`: its release and deadline.
_MIDST = f"""
transform(filter(transform(x, (a, i) -> named_struct('i', i, 'j', down[i], 'a', a)), p -> p.a.out > at * p.a.w and (p.a.w * (at - fluid.gone)) % fluid.rate > 0),
  p -> transform(array(p.a), a -> named_struct('due', ({_TIME.format(j="p.j + 1")} + a.w - 1) div a.w, 'i', p.i, 'free', {_TIME.format(j="p.j")} div a.w, 'w', a.w))[0])
"""
#: The slots from f on, less the blocks with windows within f and `at`: so many others of release f or later may be done by `at`.
_SPARE = f"transform(array(named_struct('f', f, 's', {_FLUID.format(t='f')})), q -> at - q.f - aggregate(transform(x, (o, i) -> greatest(0L, down[i] - {_UP.format(t='q.f', s='q.s')})), 0L, (t, k) -> t + k))[0]"
#: For each release among those in the middle (`frees`), and 0: how many of the blocks in the middle of that release or later may be done
#: by `at`. The least spare from the release before on counts, back to where the share of sources of earlier releases leaves room for all.
_ROOM = f"""
concat(array(named_struct('f', 0L, 'n', at - aggregate(down, 0L, (t, k) -> t + k))),
  transform(frees, (f2, k) -> named_struct('f', f2, 'n', array_min(transform(sequence(if(k = 0, f2, greatest(frees[k - 1] + 1, at - 1 - cast(ceil(size(filter(midst, p -> p.free >= f2)) * cast(total_w as double) / aggregate(midst, 0L, (t, p) -> t + if(p.free < f2, p.w, 0L))) as bigint))), f2),
      f -> {_SPARE})))))
"""
#: Earliest deadlines first, as long as there is room: the blocks in the middle that are done by `at`.
_TAKEN = """
aggregate(array_sort(midst), named_struct('room', room, 'took', cast(array() as array<int>)),
  (acc, p) -> if(exists(acc.room, r -> r.f <= p.free and r.n <= 0), acc,
    named_struct('room', transform(acc.room, r -> named_struct('f', r.f, 'n', if(r.f <= p.free, r.n - 1, r.n))), 'took', concat(acc.took, array(p.i)))),
  acc -> acc.took)
"""
#: Windows of the blocks of each source that are released before the stretch's end, from its first one that is not done.
_WINDOWS = f"""
transform(x, (a, i) -> transform(if(upto[i] > first[i], sequence(first[i], upto[i] - 1), cast(array() as array<bigint>)),
  j -> named_struct('free', {_TIME.format(j="j")} div a.w - at, 'due', ({_TIME.format(j="j + 1")} + a.w - 1) div a.w - at)))
"""
#: Earliest-deadline-first over those windows, one block a slot; ties go to the source listed first. The fluid schedule meets every
#: window, so this does too, and no slot is left empty.
_EDF = """
aggregate(sequence(0L, m - 1),
  named_struct('nxt', transform(x, o -> 0), 'out', cast(array() as array<struct<s:int,j:int>>)),
  (acc, t) -> transform(
    array(array_min(transform(windows, (v, i) -> if(acc.nxt[i] < size(v) and v[acc.nxt[i]].free <= t, named_struct('due', v[acc.nxt[i]].due, 's', i), null)))),
    p -> named_struct('nxt', transform(acc.nxt, (k, i) -> if(i = p.s, k + 1, k)),
                      'out', concat(acc.out, array(named_struct('s', p.s, 'j', acc.nxt[p.s])))))[0],
  acc -> acc.out)
"""


def shares(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, block_docs: int = 16) -> DataFrame:
    """(source, s, n blocks, size, tier, w) of each source, null included: whole weights of a unit in tier 0; alike ones for sources of no
    weight in tier 1. A block has `size` documents: block_docs, or more where there would be over MOST_BLOCKS blocks."""
    per = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    if weights is None:
        w = F.pow(F.col("docs").cast("double"), F.lit(alpha))
    else:
        good = [(F.lit(k), F.lit(float(v))) for k, v in weights.items() if isfinite(v) and v > 0]
        w = F.coalesce(F.create_map(*chain.from_iterable(good))[F.col("source")], F.lit(0.0)) if good else F.lit(0.0)
    of_all = Window.partitionBy()
    size = F.greatest(F.lit(block_docs), F.ceil(F.sum("docs").over(of_all) / MOST_BLOCKS)).cast("long")
    per = per.withColumn("w", w).select("source", "docs", "w", size.alias("size"), F.sum("w").over(of_all).alias("total"))
    s = F.row_number().over(of_all.orderBy(F.coalesce("source", F.lit("")), F.col("source").isNotNull())) - 1
    whole = F.greatest(F.lit(1), F.round(F.try_divide("w", "total") * UNIT)).cast("long")
    weighs = F.col("w") > 0
    return written(per.select("source", s.alias("s"), F.ceil(F.col("docs") / F.col("size")).alias("n"), "size", F.when(weighs, 0).otherwise(1).alias("tier"), F.when(weighs, whole).otherwise(F.lit(1).cast("long")).alias("w")))


def schedule(sources: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(s, n, tier, w) -> (s, block, slot) of every block, by earliest-deadline-first over the windows of the fluid schedule.

    The schedule is worked out in stretches of slots, each by itself in any task. What is done before a stretch follows in closed
    form: all blocks whose windows end by then, and of those in whose windows it falls the ones of the earliest deadlines that fit
    between their releases and it. That is what earliest-deadline-first from the beginning has done by then, as the sets of blocks
    that fit are a matroid. Sources of tier 1 begin when those of tier 0 have run out.

    A row of the plan holds the list of sources, and stretches are as long as that list at least, so the plan's size follows the number
    of blocks. Its time follows blocks times sources, and for each stretch the slots for which a block in the middle of its window can
    have waited: those of a source that gets one slot in thousands make it long.
    """
    x = F.array_sort(F.collect_list(F.struct("s", F.col("n").cast("long").alias("n"), F.col("w").cast("long").alias("w"))))
    tiers = sources.groupBy("tier").agg(x.alias("x"), F.sum("n").alias("total"), F.sum(F.col("w").cast("long")).alias("total_w"), F.greatest(F.lit(stretch), F.count(F.lit(1))).alias("step"))
    out = f"transform(x, a -> named_struct('s', a.s, 'n', a.n, 'w', a.w, 'out', {_TIME.format(j='a.n')}))"
    base = F.coalesce(F.sum("total").over(Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    tiers = tiers.withColumn("x", F.expr(out)).withColumn("base", base)
    rows = tiers.select("tier", "x", "base", "total", "total_w", "step", F.explode(F.expr("sequence(0L, (total - 1) div step)")).alias("k"))
    rows = rows.repartition(4 * sources.sparkSession.sparkContext.defaultParallelism, "tier", "k").withColumn("at", F.expr("k * step")).withColumn("m", F.expr("least(step, total - at)"))
    rows = rows.withColumn("fluid", F.expr(_FLUID.format(t="at"))).withColumn("after", F.expr(_FLUID.format(t="(at + m)")))
    rows = rows.withColumn("down", F.expr(f"transform(x, o -> {_DOWN.format(t='at', s='fluid')})")).withColumn("upto", F.expr(f"transform(x, o -> {_UP.format(t='(at + m)', s='after')})"))
    rows = rows.withColumn("midst", F.expr(_MIDST))
    rows = rows.withColumn("frees", F.expr("array_sort(array_distinct(transform(midst, p -> p.free)))")).withColumn("room", F.expr(_ROOM)).withColumn("taken", F.expr(_TAKEN))
    # the planner puts `taken` where it is used, which must not be within the inner function, once a source
    rows = rows.withColumn("first", F.expr("transform(array(taken), done -> transform(down, (k, i) -> if(array_contains(done, i), k + 1, k)))[0]")).withColumn("windows", F.expr(_WINDOWS))
    rows = rows.select("x", "base", "at", "first", F.posexplode(F.expr(_EDF)).alias("slot", "e"))
    return rows.select(F.expr("x[e.s].s").alias("s"), F.expr("first[e.s] + e.j").alias("block"), F.expr("base + at + slot").alias("slot"))


def mixed(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, block_docs: int = 16) -> DataFrame:
    """docs with __block, __slot, __seq: the row's block within its source, the block's slot in the mix, the row's place in it.

    Every row comes once. Target weights: `weights`, or the sources' sizes to the power `alpha`. While all sources last, each has
    within one block of its weight's share in every prefix of the mix, however long; a source that has run out leaves its share to the
    others in proportion to theirs. Sources that `weights` lacks, or gives zero, less or no number, come when the others have run
    out, in equal shares. The sources, not the rows, are brought together to plan.
    """
    sources = shares(docs, weights, alpha, block_docs)
    at = bounded(written(schedule(sources).select(F.col("s").alias("__ps"), F.col("block").alias("__pb"), F.col("slot").alias("__slot"))))
    info = bounded(sources.select(F.col("s").alias("__s"), F.col("source").alias("__source"), F.col("size").alias("__size")))
    key = F.xxhash64("text") if "text" in docs.columns else F.lit(0)
    rows = ranked(docs.withColumn("__key", key), ["source"], [F.col("doc_id"), F.col("__key")], "__rank").drop("__key")
    rows = rows.join(info, same(rows["source"], info["__source"]))
    rows = rows.withColumn("__block", F.expr("__rank div __size")).withColumn("__seq", F.expr("cast(__rank % __size as int)"))
    rows = rows.join(at, (rows["__s"] == at["__ps"]) & (rows["__block"] == at["__pb"]))
    return rows.select(*docs.columns, "__block", "__slot", "__seq")


def mix(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, block_docs: int = 16) -> DataFrame:
    """(doc_id, source, ...) -> (doc_id, source, block, slot, seq), a row per row of docs; (slot, seq) is the order of the mix.

    A null source is a source of its own; repeated rows and null doc_ids each have their place; an empty table gives an empty
    result; texts are not read; other columns of docs are not used.
    """
    got = mixed(docs.select("doc_id", "source"), weights, alpha, block_docs)
    return got.select("doc_id", "source", F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__seq").alias("seq"))


def in_order(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, block_docs: int = 16, parts: int | None = None) -> DataFrame:
    """All rows of docs in the order of the mix, in `parts` partitions of consecutive slots (as many as a shuffle has if None), so
    that files written from it hold that order. All columns stay; nulls, repeated rows and empty tables as in mix().

    The mix is worked out on narrow rows and written; rows with their texts are shuffled twice: to their places, which they find by a
    128-bit hash of doc_id, source and text, and into the order. Rows alike in these take their hash's places in turn.
    """
    spark = docs.sparkSession
    said = ["doc_id", "source", *[F.col(c) for c in ("text",) if c in docs.columns]]
    null = [F.col(c).isNull() for c in ("doc_id", "source", "text") if c in docs.columns]
    rows = docs.withColumns({"__k1": F.xxhash64(*said, *null), "__k2": F.xxhash64(F.lit("second"), *said, *null)})
    narrow = mixed(rows.select("source", F.col("__k1").alias("doc_id"), F.col("__k2").alias("text")), weights, alpha, block_docs)
    narrow = Written(narrow.select(F.col("doc_id").alias("__p1"), F.col("text").alias("__p2"), F.struct("__slot", "__seq").alias("__at")))
    per = Written(narrow.df.groupBy("__p1", "__p2").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__at")))
    last, alike = narrow.df.select(F.max("__at.__slot")).first()[0], not per.df.where("__n > 1").isEmpty()
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = -(-((last or 0) + 1) // parts)
    found = rows.join(per.df, (F.col("__k1") == F.col("__p1")) & (F.col("__k2") == F.col("__p2"))).drop("__p1", "__p2")
    out = found.where("__n = 1")
    if alike:
        nth = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(*key)).alias("__nth")
        several = narrow.df.join(per.df.where("__n > 1").select("__p1", "__p2"), ["__p1", "__p2"]).select("*", nth("__p1", "__p2"))
        more = found.where("__n > 1").drop("__at").select("*", nth("__k1", "__k2"))
        several = several.select("__p1", "__p2", F.col("__nth").alias("__pth"), "__at")
        more = more.join(several, (F.col("__k1") == F.col("__p1")) & (F.col("__k2") == F.col("__p2")) & (F.col("__nth") == F.col("__pth")))
        out = out.unionByName(more.select(*out.columns))
    return out.repartitionById(parts, F.expr(f"cast(__at.__slot div {each} as int)")).sortWithinPartitions("__at").select(*docs.columns)
