"""Mixing sources to target weights by systematic sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millwatch.llm.common import carried, stage

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: The most copies of a document, and so the most times a source may be taken.
MOST_COPIES = 3
#: Documents of one source and size are numbered in so many independent groups, each split by blocks of doc_id, or of the
#: text's hash where that is null: a block holds at most 2^20 / 64 ids of a group.
SALTS = 64
ID_BITS = 20
HASH_BITS = 44
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)``: the whole size shared by weight, no source above three times its own.

    Sources fill up in order of cap over weight; the level all others reach follows from running sums, so
    resharing the excess needs no loop. One row per source: this is the only table ordered as a whole.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn % len(WEIGHTS) + 1).cast("int"))
    rated = totals.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * MOST_COPIES).alias("cap"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = rated.withColumns({"turn": F.row_number().over(order), "level": left / weights})
    full = F.col("cap") <= F.col("level") * F.col("weight")
    first = F.min(F.when(~full, F.struct("turn", "level"))).over(every)
    levels = levels.withColumn("first", first)
    under = F.col("first").isNotNull() & (F.col("turn") >= F.col("first.turn"))
    target = F.when(under, F.col("first.level") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return levels.select("source", "source_size", target.alias("target"))


def copy_counts(docs: DataFrame, seed: int = 7) -> DataFrame:
    """How often a mix to target weights takes each row: ``doc_id, source, size, source_size, target, copies,
    taken, text_hash``.

    Within a source every document has the same expected copies, target over size of the source. Documents are
    numbered by (size, doc_id mod 64, doc_id); one offset per source, drawn from ``seed`` and its name, is added to
    the running sum of expected copies, and a document is emitted once per integer the sum crosses. As neighbours
    are of like size, the words taken miss the target by about one longest document at most.

    The running sum has levels: counts per (source, size, doc_id mod 64) and, within them, per block of doc_id give each
    block its start, and only inside a block are rows ordered. So a source with a third of all rows is many tasks, and
    so are any number of documents of one source and size. Only rows that share their doc_id, or have none and share their text, stay together.

    A null or empty text has size 0 and takes 0 words; a null source is a source of its own, last in order; a null doc_id
    is numbered like any other, after them. Repeated rows are separate documents. An empty table gives an empty
    result. Columns other than doc_id, text and source are ignored.
    """
    hashed = F.xxhash64("text").alias("text_hash")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    sizes = stage(docs.select("doc_id", "source", size, hashed), "sizes")
    targets = stage(source_targets(sizes), "targets")
    salted = sizes.withColumn("salt", F.coalesce(F.pmod("doc_id", F.lit(SALTS)), F.lit(SALTS)).cast("int"))
    of_id, of_hash = F.shiftright(F.col("doc_id").cast("long"), ID_BITS), F.shiftright("text_hash", HASH_BITS)
    salted = salted.withColumn("block", F.when(F.col("doc_id").isNull(), of_hash).otherwise(of_id))
    blocks = stage(salted.groupBy("source", "size", "salt", "block").agg(F.count("*").alias("n")), "blocks")
    groups = blocks.groupBy("source", "size", "salt").agg(F.sum("n").alias("n"))
    # Two levels again: a source with very many sizes is not one window.
    step = F.floor(F.col("size") / 64)
    per_step = groups.groupBy("source", step.alias("step")).agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    per_step = per_step.select(F.col("source").alias("s"), F.col("step").alias("st"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "step").orderBy("size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("step", step).withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    starts = starts.join(per_step, F.col("source").eqNullSafe(F.col("s")) & (F.col("step") == F.col("st")))
    starts = starts.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("salt").alias("g"), (F.col("base") + F.col("within")).alias("base"))
    sooner = Window.partitionBy("source", "size", "salt").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("within", F.coalesce(F.sum("n").over(sooner), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("salt") == F.col("g")))
    starts = stage(placed.select("source", "size", "salt", "block", (F.col("base") + F.col("within")).alias("start")), "starts")
    starts = starts.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    starts = starts.select(*(F.col(c).alias(f"of_{c}") for c in starts.columns))
    row = Window.partitionBy("source", "size", "salt", "block").orderBy("doc_id", "text_hash")
    numbered = salted.withColumn("row", F.row_number().over(row))
    numbered = numbered.join(
        starts,
        F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))
        & (F.col("salt") == F.col("of_salt")) & (F.col("block") == F.col("of_block")),
    )
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    offset = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("of_source_size") > 0, F.col("of_target") / F.col("of_source_size")).otherwise(0.0)
    place = F.col("of_start") + F.col("row")
    crossed = F.floor(rate * place + offset) - F.floor(rate * (place - 1) + offset)
    copies = F.least(crossed, F.lit(MOST_COPIES)).cast("long")
    return numbered.select(
        "doc_id", "source", "size", F.col("of_source_size").alias("source_size"), F.col("of_target").alias("target"),
        copies.alias("copies"), (copies * F.col("size")).alias("taken"), "text_hash",
    )


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns unchanged, whatever their names.

    Counts meet their rows by doc_id and the hash of the text; rows equal in both share their counts evenly in
    order of source, then of their other columns. Rows with a null doc_id are matched by their text alone.
    """
    counts = copy_counts(docs, seed).select("doc_id", "source", "copies", "text_hash")
    key = ("doc_id", "text_hash", "source")
    # Equal rows: their counts are added up, and each row then takes its part by its place among them.
    summed = counts.groupBy(*key).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    summed = summed.where("copies > 0").select(F.col("doc_id").alias("__mix_id"), F.col("text_hash").alias("__mix_hash"), F.col("source").alias("__mix_source"), F.col("copies").alias("__mix_copies"), F.col("rows").alias("__mix_rows"))
    on = F.col("doc_id").eqNullSafe(F.col("__mix_id")) & (F.xxhash64("text") == F.col("__mix_hash")) & F.col("source").eqNullSafe(F.col("__mix_source"))
    packed, columns = carried(docs, keys=("doc_id", "text", "source"))
    joined = packed.join(summed, on)
    place = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text"), "source").orderBy(F.to_json("__row")))
    alone = joined.where("__mix_rows = 1").withColumn("__mix_n", F.col("__mix_copies"))
    again = joined.where("__mix_rows > 1").withColumn("__mix_place", place)
    share = F.floor(F.col("__mix_copies") * F.col("__mix_place") / F.col("__mix_rows")) - F.floor(F.col("__mix_copies") * (F.col("__mix_place") - 1) / F.col("__mix_rows"))
    again = again.withColumn("__mix_n", share.cast("long")).drop("__mix_place")
    every = alone.unionByName(again).where("__mix_n > 0")
    return every.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_n")))).select(*columns)
