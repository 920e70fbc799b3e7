"""Mixing sources to target weights (operator 3): a low-discrepancy schedule of source slots over shuffled equal-token blocks.

Targets.  Sources in code point order (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at
``epochs`` times its source's words, and the excess is shared again by weight (solved in closed form over the sources in
order of cap / weight).

Schedule.  Point t of the golden-ratio sequence falls into the cumulative target weights and names slot t's source; slots
are ranked per source.  Slot r of a source draws words [r * block, (r + 1) * block) of the source's shuffled stream,
which repeats from its start after each epoch.  Slots beyond a source's target are passed over; what a source still lacks after
the last point (the sequence's discrepancy) is appended.  The targets say how many words of a source are taken; the schedule says when:
``slots`` holds, for each pass over the source, the first slot that draws from the row, and ``mixed`` lays the rows out in that order.

Ranks and stream offsets are prefix sums in two levels (sums of chunks or hash ranges first), so a source with a third
of all rows is never in one task; the numbers of ranges and cells grow with the rows and the slots.  The per-source table has one row a
source; its windows run in one task.  Rows equal in doc_id and text share a range.

Null text: size 0, taken 0.  Null source: a source of its own, last.  Null doc_id, several rows with one doc_id: a row each; ties of the shuffle go by
doc_id, size, row.  Very long texts: counted whole, drawn by as many slots as they need.  Empty table: empty
result.  Extra columns are ignored, or carried in ``given``.  Nothing is random: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

BLOCK_WORDS = 2048
EPOCHS = 3
GOLDEN = 0.6180339887498949
CHUNK = 1 << 16
#: rows of a range of the shuffle, slots of a cell of the unit interval (on average)
RANGE_ROWS, CELL_SLOTS = 1 << 16, 1 << 13
WORD = r"[^\x20\x09-\x0D]+"


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _fraction(x: Column) -> Column:
    return x - F.floor(x)


def targets(sized: DataFrame, weights: tuple = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, place (in code point order), target, lo and hi (its part of the unit interval); a row a source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    cap = F.lit(float(epochs)) * F.col("source_size")
    order = W.orderBy(cap / F.col("weight"), "place")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy(F.lit(0))
    per = per.withColumn("share", (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after))
    free = F.when(F.col("share") * F.col("weight") <= cap, F.struct(cap / F.col("weight"), "place", "share"))
    per = per.withColumn("level", F.min(free).over(every)["share"])
    per = per.withColumn("target", F.least(cap, F.coalesce("level", F.lit(0.0)) * F.col("weight")))
    hi = F.sum("target").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    total = F.greatest(F.sum("target").over(every), F.lit(1e-300))
    return per.select("source", "source_size", "place", "target", ((hi - F.col("target")) / total).alias("lo"), (hi / total).alias("hi"), F.round("target").cast("long").alias("need"), F.sum("source_size").over(every).alias("all_size"))


def schedule(per: DataFrame, n_slots: int, block: int) -> DataFrame:
    """slot, place, rank: the slots that are drawn, in order; ``n_slots`` points and what sources lack after them."""
    spark = per.sparkSession
    point = F.col("id")
    x = _fraction(_fraction(F.floor(point / CHUNK) * F.lit((CHUNK * GOLDEN) % 1.0)) + _fraction((point % CHUNK) * F.lit(GOLDEN)) + F.lit(0.5))
    points = spark.range(0, n_slots, 1, C.shuffle_partitions(spark)).select(F.col("id").alias("slot"), F.floor(point / CHUNK).alias("chunk"), x.alias("x"))
    cells = n_slots // CELL_SLOTS + 1
    points = points.withColumn("cell", F.floor(F.col("x") * cells).cast("int"))
    slots_of = F.ceil(F.col("need") / F.lit(float(block))).cast("long")
    # a source's part begins in each cell that it reaches into; a point belongs to the last beginning before it
    spans = per.where("hi > lo").select("place", "lo", slots_of.alias("slots"), F.explode(F.sequence(F.floor(F.col("lo") * cells).cast("int"), F.least(F.lit(cells - 1), F.floor(F.col("hi") * cells).cast("int")))).alias("cell"))
    spans = spans.select("cell", F.greatest("lo", F.col("cell") / F.lit(float(cells))).alias("x"), F.struct("lo", "place", "slots").alias("of"))
    none = F.lit(None)
    both = spans.select("cell", "x", "of", none.cast("long").alias("slot"), none.cast("long").alias("chunk")).union(points.select("cell", "x", none.cast("struct<lo:double,place:int,slots:bigint>"), "slot", "chunk"))
    so_far = W.partitionBy("cell").orderBy("x", F.col("slot").asc_nulls_first(), F.col("of.lo")).rowsBetween(W.unboundedPreceding, 0)
    drawn = both.withColumn("of", F.last("of", ignorenulls=True).over(so_far)).where("slot IS NOT NULL AND of IS NOT NULL").select("slot", "chunk", "of.place", "of.slots")
    sums = drawn.groupBy("place", "chunk").agg(F.count(F.lit(1)).alias("n"))
    base = sums.select("place", "chunk", (F.sum("n").over(W.partitionBy("place").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    ranked = drawn.join(base, ["place", "chunk"]).select("slot", "place", "slots", (F.col("base") + F.row_number().over(W.partitionBy("place", "chunk").orderBy("slot")) - 1).alias("rank"))
    drawn_of = sums.groupBy("place").agg(F.sum("n").alias("n"))
    lack = per.select("place", slots_of.alias("slots")).join(drawn_of, "place", "left").select("place", "slots", F.coalesce("n", F.lit(0)).alias("n")).where("n < slots")
    lack = lack.select("place", F.explode(F.sequence(F.col("n"), F.col("slots") - 1)).alias("rank")).select((F.lit(n_slots) + F.col("rank")).alias("slot"), "place", "rank")
    return ranked.where("rank < slots").select("slot", "place", "rank").union(lack)


def mix(docs: DataFrame, block: int = BLOCK_WORDS, epochs: int = EPOCHS, weights: tuple = (1, 2, 3), keep: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, slots (of each pass over the source, null if it draws nothing), first_slot; a row for each row of ``docs``.

    With ``keep``, each row of ``docs`` as well, as the struct ``given``: found again by a number of the row, not by its doc_id.
    """
    spark = C.ready(docs.sparkSession)
    if keep:
        whole = C.cut(docs.select(F.struct(*map(_quoted, docs.columns)).alias("given"), F.monotonically_increasing_id().alias("row")))
        docs = whole.select("given.doc_id", "given.source", "given.text", "row")
    row = F.col("row") if keep else F.lit(0).cast("long")
    mixer = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    sized = C.cut(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), mixer.alias("shuffle"), row.alias("row")))
    per = C.cut(targets(sized, weights, epochs))
    total = per.select(F.max("all_size")).first()[0] or 0
    slots = schedule(per, -(-total // block), block)
    # ranges keep the order of the shuffle, so their number changes nothing
    bits = max(C.shuffle_partitions(spark), sized.count() // RANGE_ROWS).bit_length()
    sized = sized.withColumn("range", F.shiftright("shuffle", 63 - bits))
    sums = sized.groupBy("source", "range").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    ranges = sums.select("source", "range", before.alias("base")).join(per, sums["source"].eqNullSafe(per["source"])).select(sums["source"].alias("s"), F.col("range").alias("r"), "base", "place", "source_size", "target", "need")
    within = W.partitionBy("place", "range").orderBy("shuffle", "doc_id", "size", "row")
    laid = sized.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    laid = laid.withColumn("line", F.row_number().over(within)).withColumn("off", F.col("base") + F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    start = F.col("epoch") * F.col("source_size") + F.col("off")
    stop = F.least(start + F.col("size"), F.col("need"))
    per_epoch = laid.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).select("*", start.alias("start"), stop.alias("stop")).where("stop > start")
    pieces = per_epoch.withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))))
    words = F.least(F.col("stop"), (F.col("rank") + 1) * block) - F.greatest(F.col("start"), F.col("rank") * block)
    each = F.array(*(F.min(F.when(F.col("epoch") == e, F.col("slot"))) for e in range(epochs)))
    drawn = pieces.join(slots, ["place", "rank"]).groupBy("place", "range", "line").agg(F.sum(words).alias("taken"), each.alias("slots"), F.min("slot").alias("first_slot"))
    out = laid.join(drawn, ["place", "range", "line"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "slots", "first_slot", *(["off", "row"] if keep else []))
    return out.join(whole.hint("merge"), "row").drop("row") if keep else out


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them (taken words over size, rounded), laid out in the order of the slots that draw them."""
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    taken = mix(docs, keep=True, **options).where("taken > 0").select("given", "slots", "off", "first_slot", times.alias("times")).where("times > 0")
    copies = taken.select("given", "off", "slots", "first_slot", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
    slot = F.coalesce(F.get("slots", F.col("copy")), F.col("first_slot"))
    rows = copies.select(slot.alias("slot"), "off", "given")
    return rows.repartitionByRange(C.shuffle_partitions(docs.sparkSession), "slot", "off").sortWithinPartitions("slot", "off").select("given.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(C.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")
