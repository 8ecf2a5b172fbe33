"""Chat formatting after collapse of cumulative snapshots, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Written, bounded, written

#: Turn numbers of a bucket, and turns of a chunk: what one task numbers, hashes and renders at once.
BUCKET = 256


def line(role: Column, text: Column) -> Column:
    """A turn in chat markup. Markup within role or text is broken by a space, so that neither can open or close a turn."""
    plain = lambda x: F.replace(x, F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit("<|im_start|>"), plain(F.coalesce(role, F.lit("unknown"))), F.lit("\n"), plain(F.coalesce(text, F.lit(""))), F.lit("<|im_end|>\n"))


def _hashes(pos: Column) -> list[Column]:
    """A turn's hash from its position and markup, twice 64 bits."""
    return [F.xxhash64(pos, "line").alias("h1"), F.xxhash64(F.lit("second"), pos, "line").alias("h2")]


def _with_earlier(rows: DataFrame, per: DataFrame, totals: dict) -> DataFrame:
    """rows, and of the aggregates of per's rows by bucket k what the earlier buckets of the conversation come to."""
    low = Window.partitionBy("k.conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    per = per.groupBy("k").agg(*[agg.alias(name) for name, (agg, _) in totals.items()])
    return rows.join(per.select("k", *[F.coalesce(over(name).over(low), F.lit(0)).alias(name) for name, (_, over) in totals.items()]), "k")


def numbered(conversations: DataFrame) -> DataFrame:
    """(k, pos, line, x1, x2) of the rows with a conv_id: turns numbered from 1 in k's conversation, with the rolling hash of the turns
    of bucket k up to each.

    A bucket k holds a conversation's turns of BUCKET turn numbers (of the first letters, where there is no turn number). This is the
    one place where texts are shuffled before it is known which conversations stay: by bucket, with what the earlier ones count.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null")
    none = F.col("turn").isNull()
    key = F.struct("conv_id", F.floor(F.col("turn") / BUCKET).alias("b"), F.when(none, F.col("role")).alias("role"), F.when(none, F.left("text", F.lit(2))).alias("first"))
    rows, inner = rows.withColumn("k", key).drop("conv_id"), Window.partitionBy("k")
    rows = _with_earlier(rows, rows, {"before": (F.count(F.lit(1)), F.sum)})
    pos = F.col("before") + F.row_number().over(inner.orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")))
    rows = rows.select("k", pos.alias("pos"), line(F.col("role"), F.col("text")).alias("line"))
    rows = rows.select("*", *_hashes(F.col("pos")))
    upto = inner.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("k", "pos", "line", F.bit_xor("h1").over(upto).alias("x1"), F.bit_xor("h2").over(upto).alias("x2"))


def loose(conversations: DataFrame) -> DataFrame:
    """(pos, line, x1, x2) of the rows without a conv_id, each a conversation of one turn; equal ones are made one, within map tasks first."""
    rows = conversations.where("conv_id is null").select(line(F.col("role"), F.col("text")).alias("line")).distinct()
    rows = rows.select(F.lit(1).cast("long").alias("pos"), "line")
    return rows.select("*", *_hashes(F.col("pos"))).withColumnsRenamed({"h1": "x1", "h2": "x2"})


def prefixes(turn_rows: DataFrame, single: DataFrame) -> DataFrame:
    """numbered() and loose() -> (conv_id, pos, x1, x2), without texts: the rolling hash of all turns of a conversation up to each, the
    exclusive-or of those of its earlier buckets and its own."""
    rows = turn_rows.select("k", "pos", "x1", "x2")
    rows = _with_earlier(rows, rows, {"e1": (F.max_by("x1", "pos"), F.bit_xor), "e2": (F.max_by("x2", "pos"), F.bit_xor)})
    rows = rows.select("k.conv_id", "pos", F.col("x1").bitwiseXOR(F.col("e1")).alias("x1"), F.col("x2").bitwiseXOR(F.col("e2")).alias("x2"))
    return rows.unionByName(single.select(F.lit(None).cast(rows.schema["conv_id"].dataType).alias("conv_id"), "pos", "x1", "x2"))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, x1, x2) of every turn; see prefixes()."""
    return prefixes(numbered(conversations), loose(conversations))


def maximal(turn_rows: DataFrame) -> DataFrame:
    """(conv_id, x1, x2) of the conversations that are no prefix of a longer one, with the hash of the whole; of equal ones that with the
    smallest conv_id.

    A conversation's last turn carries the hash of the whole. Of all turns with one number and hash, those that are not last
    extend it; if there are any, the conversation is anti-joined away. Both sides are counted per hash within map tasks first, so
    a very common opening is one row.
    """
    whole = turn_rows.where("conv_id is not null").groupBy("conv_id").agg(F.max_by(F.struct("pos", "x1", "x2"), "pos").alias("last")).select("conv_id", "last.*")
    whole = whole.unionByName(turn_rows.where("conv_id is null"))
    whole = whole.groupBy("pos", "x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("whole"))
    seen = turn_rows.groupBy(F.col("pos").alias("p"), F.col("x1").alias("y1"), F.col("x2").alias("y2")).agg(F.count(F.lit(1)).alias("times"))
    extended = (whole["pos"] == seen["p"]) & (whole["x1"] == seen["y1"]) & (whole["x2"] == seen["y2"]) & (seen["times"] > whole["whole"])
    return whole.join(seen, extended, "left_anti").select("conv_id", "x1", "x2")


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, ...) -> (conv_id, chunk, n_turns, text): maximal conversations in chat markup.

    Turns go by turn (nulls first), then role and text; a null role is written `unknown`, a null text is empty, rows that repeat
    a turn are turns, and rows without a conv_id are conversations of one turn each. Conversations are equal, or one begins
    another, by their markup. A chunk holds up to BUCKET turns (n_turns of them), so nearly all conversations are chunk 0 alone; a
    longer one's text is its chunks' texts in order. Texts are whole, of any length. An empty table gives an empty result; other
    columns are not used.
    """
    rows, single = Written(numbered(conversations)), loose(conversations)
    keep = written(maximal(prefixes(rows.df, single)))
    named = bounded(keep.where("conv_id is not null").select(F.col("conv_id").alias("__keep")))
    kept = rows.df.select("k.conv_id", "pos", "line").join(named, F.col("conv_id") == F.col("__keep"), "left_semi")
    kept = kept.groupBy("conv_id", F.expr(f"cast((pos - 1) div {BUCKET} as int)").alias("chunk")).agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("xs"))
    kept = kept.select("conv_id", "chunk", "n_turns", F.array_join(F.transform("xs", lambda x: x["line"]), "").alias("text"))
    none = keep.where("conv_id is null").select("conv_id", F.col("x1").alias("y1"), F.col("x2").alias("y2"))
    alone = single.join(none, (F.col("x1") == F.col("y1")) & (F.col("x2") == F.col("y2")))
    return kept.unionByName(alone.select("conv_id", F.lit(0).alias("chunk"), F.lit(1).cast("long").alias("n_turns"), F.col("line").alias("text")))
