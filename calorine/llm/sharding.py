"""Sharding along a Hilbert curve, all in DataFrame functions.

Each row's metadata dimensions are quantised to a few bits, names by their rank and so in their own order, the point's
position on the Hilbert curve is its sort key, and the sorted rows are cut into runs of equal row counts.  Neighbours on the
curve are close in every dimension, so each shard covers a small box and its files' least and greatest values let a
filter on any of the dimensions skip most files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calorine.llm.common import Steps

#: Bits for each dimension: 3 dimensions of 4 bits give 4,096 cells, a bound that doesn't grow with the data.
BITS = 4
#: The rows of each cell are dealt to at least SALTS groups, and to more where there are more than SALTED rows for each,
#: so that a cell with a third of all rows is no single task's work.
SALTS, SALTED = 64, 1_000_000
#: Distinct names of a dimension that are broadcast; more are joined by a shuffle.
BROADCAST = 100_000


def hilbert_table(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """(code, cell) for each of the ``2**(dims*bits)`` points: their packed coordinates and place on the curve.

    Skilling's transform: undo the rotations from the highest bit down, Gray-code the axes, interleave their bits.
    Each step is a projection of its own, so that no expression is evaluated twice.
    """
    names = [f"x{i}" for i in range(dims)]
    x = lambda i: F.col(names[i])
    mask = (1 << bits) - 1
    points = spark.range(1 << dims * bits).select(F.col("id").alias("code"), *[F.shiftright("id", bits * (dims - 1 - i)).bitwiseAND(mask).cast("int").alias(names[i]) for i in range(dims)])
    tops = [1 << b for b in range(bits - 1, 0, -1)]
    for q in tops:
        for i in range(dims):
            has = x(i).bitwiseAND(q) != 0
            swap = x(0).bitwiseXOR(x(i)).bitwiseAND(q - 1)
            first = x(0).bitwiseXOR(F.when(has, F.lit(q - 1)).otherwise(swap))
            moved = {0: first} | ({i: x(i).bitwiseXOR(F.when(has, F.lit(0)).otherwise(swap))} if i else {})
            points = points.select("code", *[moved.get(k, x(k)).alias(names[k]) for k in range(dims)])
    for i in range(1, dims):
        points = points.withColumn(names[i], x(i).bitwiseXOR(x(i - 1)))
    points = points.withColumn("turn", F.lit(0))
    for q in tops:
        points = points.withColumn("turn", F.when(x(dims - 1).bitwiseAND(q) != 0, F.col("turn").bitwiseXOR(q - 1)).otherwise(F.col("turn")))
    for n in names:
        points = points.withColumn(n, F.col(n).bitwiseXOR(F.col("turn")))
    places = [(b, i) for b in range(bits - 1, -1, -1) for i in range(dims)]
    bit = lambda b, i: F.shiftright(x(i), b).bitwiseAND(1).cast("long")
    return points.select("code", sum((F.shiftleft(bit(b, i), len(places) - 1 - k) for k, (b, i) in enumerate(places)), F.lit(0).cast("long")).alias("cell"))


def level(value: Column, bits: int) -> Column:
    """A number by its order of magnitude: whole octaves from 8 on, at most ``2**bits - 1``."""
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.greatest(value, F.lit(1)) / 8.0 + 1)).cast("int"))


def ranks(names: DataFrame, bits: int, steps: Steps) -> DataFrame:
    """(axis, name, place) of the distinct values of ``names`` (axis, name), in order: ``2**bits`` places an axis at most.

    Up to so many names of an axis each have a place of their own, spread over the whole axis, since the curve resolves its high bits
    first; of more, each place takes an equal share of the rows.  The sums over the names before one come from sums over ranges of names, so that no task orders all of them.
    """
    most = 1 << bits
    counts = names.groupBy("axis", "name").agg(F.count(F.lit(1)).alias("n"))
    ranged = steps.write(counts.repartitionByRange("axis", "name").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("axis", "part").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("m"))  # a row or two a partition
    ahead = Window.partitionBy("axis").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("axis")
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = parts.select("axis", "part", zero(F.sum("k").over(ahead)).alias("k0"), zero(F.sum("m").over(ahead)).alias("m0"), F.sum("k").over(whole).alias("kinds"), F.sum("m").over(whole).alias("rows"))
    inside = Window.partitionBy("axis", "part").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.withColumns({"k1": zero(F.count(F.lit(1)).over(inside)), "m1": zero(F.sum("n").over(inside))}).join(F.broadcast(parts), ["axis", "part"])
    place = F.when(F.col("kinds") <= most, F.floor((F.col("k0") + F.col("k1")) * most / F.col("kinds"))).otherwise(F.floor((F.col("m0") + F.col("m1")) * most / F.col("rows")))
    made = steps.write(before.select("axis", "name", place.cast("int").alias("place")))
    steps.drop(ranged)
    return made


def _keyed(docs: DataFrame, bits: int, steps: Steps, carry: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, cell, salt) of every row, with ``carry`` also its columns as ``row``.

    The rows are read once and written, so that all further passes see the same; a number that is written with them
    parts even equal rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c)  # noqa: E731  null is a name of its own, before all
    whole = [F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")] if carry else []
    number = F.monotonically_increasing_id().alias("number")
    rows = steps.write(docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), name("lang"), name("source"), number, *whole))
    axes = ("source", "lang")
    places = ranks(rows.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("name")) for a in axes])).alias("v")).select("v.*"), bits, steps)
    few = places.count() <= BROADCAST
    placed, code = rows, level(F.col("size"), bits).cast("long")
    for i, axis in enumerate(axes, 1):
        own = places.where(F.col("axis") == axis).select(F.col("name").alias(axis), F.col("place").alias(f"{axis}_place"))
        placed = placed.join(F.broadcast(own) if few else own, axis)
        code = code + F.shiftleft(F.col(f"{axis}_place").cast("long"), bits * i)
    curve = steps.write(hilbert_table(docs.sparkSession, 3, bits))  # 2**(3*bits) rows, whatever the data
    salt = F.pmod(F.xxhash64("doc_id", "text_crc32", "number"), F.lit(max(SALTS, rows.count() // SALTED))).cast("int").alias("salt")
    keyed = placed.withColumn("code", code).join(F.broadcast(curve), "code").select("doc_id", "size", "text_crc32", "cell", salt, *(["row"] if carry else []))
    if carry:
        return keyed
    keyed = steps.write(keyed)
    steps.drop(*[w for w, _ in steps.written if w is not keyed])
    return keyed


def _starts(rows: DataFrame) -> DataFrame:
    """(cell, salt, start, total): how many rows come before those of each cell and salt, and how many there are."""
    counts = rows.groupBy("cell", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("cell") / 64))
    inside = Window.partitionBy("block").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("m"))  # at most 2**(3*bits) / 64 rows
    ahead = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    blocks = blocks.select("block", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("ahead"), F.sum("m").over(whole).alias("total"))
    return cells.join(blocks, "block").select("cell", "salt", (F.col("before") + F.col("ahead")).alias("start"), "total")


def _placed(rows: DataFrame, starts: DataFrame, n_shards: int) -> DataFrame:
    """``rows`` with their shard and slot."""
    own = Window.partitionBy("cell", "salt").orderBy("doc_id", "size", "text_crc32")
    ranked = rows.withColumn("own", F.row_number().over(own) - 1).join(starts, ["cell", "salt"]).withColumn("rank", F.col("start") + F.col("own"))
    # The largest k with ceil(k*total/n) <= rank is floor(rank*n/total), in whole numbers.
    ranked = ranked.withColumn("shard", F.expr(f"(rank * {n_shards}) div total").cast("int"))
    first = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("slot", (F.col("rank") - first).cast("long"))


def assign_shards(docs: DataFrame, n_shards: int, bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    Dimensions: language, source and size.  Rows are ranked by (curve index, salt, doc_id, size, crc) and shard
    ``k`` takes the ranks from ``ceil(k*n/n_shards)`` on, so counts differ by one at most (law ``rows``);
    ``slot`` counts from 0 in each shard.  A null text has no bytes and the crc of the empty string; null languages
    and sources are values of their own; null ids are ids; repeated rows each keep a slot; an empty table gives no rows;
    very long texts count whole; further columns are ignored.

    The ranks come from counts of (cell, salt), summed within blocks of cells and then over the blocks, so that no task
    orders all rows.  Only keys are shuffled, never texts.
    """
    steps = Steps(docs.sparkSession, "sharding")
    rows = _keyed(docs, bits, steps)  # only keys are written, never texts
    placed = _placed(rows, _starts(rows), n_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, n_shards: int, path: str, bits: int = BITS, rows_a_file: int = 100_000) -> None:
    """Write the rows of ``docs``, all columns, as one Parquet folder a shard in slot order, by the law of ``assign_shards``.

    The folders are named by a further column ``shard`` (``shard_`` where that is taken).  Null and repeated ids, and
    repeated rows, each keep their place; an empty table writes nothing but its schema.
    """
    steps = Steps(docs.sparkSession, "sharding")
    rows = _keyed(docs, bits, steps, carry=True)
    placed = _placed(rows, steps.write(_starts(rows.drop("row"))), n_shards)
    name = "shard"
    while name in docs.columns:
        name += "_"
    out = placed.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    out = out.repartition("__shard", F.floor(F.col("__slot") / rows_a_file)).sortWithinPartitions("__shard", "__slot")
    out.drop("__slot").withColumnRenamed("__shard", name).write.partitionBy(name).parquet(path)
    steps.drop(*[w for w, _ in steps.written])
