"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata dimensions are quantised to `BITS` bits each at their quantiles, so that every dimension
spreads over its cells; the Hilbert index of the cell orders the rows, and the order is cut into shards of near
equal bytes.  Files written by shard then cover small boxes in all dimensions, and readers prune by any
of them.  Law `bytes`: a row goes to the shard in which the middle of its bytes falls, so no shard is
off its share by more than one row's size.  Within a cell, rows are ordered by the hash of the text, so equal
texts with equal metadata stand side by side.

Ranks and byte offsets over all rows come from three levels of sums, none of which sees an unbounded
group: the texts are read once, into a narrow table of metadata; the curve index is refined with bits of the text's and the key's hash into cells; windows run
within a cell; sums per cell are accumulated within blocks of cells, and the sums of at most
2**12 blocks in one small window.  Texts never enter a shuffle, only their size and hashes.

Defined results: a null text has size 1 (as the empty one) and text_crc32 null; equal rows get neighbouring slots; an
empty table gives no rows; null dimensions count as the lowest cell; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caduspark.llm import shared

BITS, SHARDS = 4, 16
#: Cells of the curve are split into 2**TEXT_BITS by text and 2**KEY_BITS by key, for hot cells and hot texts.
TEXT_BITS, KEY_BITS = 4, 6


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def value_of(df: DataFrame, name: str) -> Column:
    """What a dimension is ordered by: the number, or the whole text."""
    return F.col(f"`{name}`").cast("double" if df.schema[name].dataType.simpleString() in NUMBERS else "string")


def text_cuts(rows: DataFrame, names: list[str], bits: int) -> dict[str, list[str]]:
    """Quantiles of text columns, 2**bits - 1 each (none for a column of nulls), by running sums over the distinct values' counts.

    Values are dealt out by range, so that no sum runs over more than one part's values.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(n).alias("value")) for i, n in enumerate(names)])
    counts = rows.select(F.inline(pairs)).where("value is not null").groupBy("dim", "value").agg(F.count("*").alias("n"))
    counts = shared.write_table(counts.repartitionByRange("dim", "value").withColumn("part", F.spark_partition_id()), "values")
    of = Window.partitionBy("dim")  # as many rows as parts
    parts = counts.groupBy("dim", "part").agg(F.sum("n").alias("pn"))
    parts = parts.select("dim", "part", (F.sum("pn").over(of.orderBy("part")) - F.col("pn")).alias("c0"), F.sum("pn").over(of).alias("total"))
    upto = F.col("c0") + F.sum("n").over(Window.partitionBy("dim", "part").orderBy("value"))
    ranked = counts.join(F.broadcast(parts), ["dim", "part"]).select("dim", "value", "n", upto.alias("upto"), "total")
    share = lambda c: F.floor(c * (1 << bits) / F.col("total")).cast("int")
    ranked = ranked.select("dim", "value", (share(F.col("upto") - F.col("n")) + 1).alias("first"), F.least(share(F.col("upto")), F.lit((1 << bits) - 1)).alias("last"))
    found = ranked.where("first <= last").select("dim", "value", F.explode(F.sequence("first", "last")).alias("cut")).collect()
    shared.drop_table(counts)
    return {n: [r["value"] for r in sorted(found, key=lambda r: r["cut"]) if r["dim"] == i] for i, n in enumerate(names)}


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Hilbert index of a point whose coordinates are integer columns of `bits` bits (Skilling's transform).

    The transform's steps are unrolled into column expressions; `let` keeps each step's value single.
    """
    n = len(axes)
    state = F.array(*[a.cast("int") for a in axes])

    def let(value: Column, step) -> Column:
        return F.transform(F.array(value), step)[0]

    def pick(x: Column) -> list[Column]:
        return [x[i] for i in range(n)]

    def undo(i: int, q: int, p: int):
        def step(x: Column) -> Column:
            v = pick(x)
            on = v[i].bitwiseAND(F.lit(q)) != 0
            t = v[0].bitwiseXOR(v[i]).bitwiseAND(F.lit(p))
            first = F.when(on, v[0].bitwiseXOR(F.lit(p))).otherwise(v[0].bitwiseXOR(t))
            other = F.when(on, v[i]).otherwise(v[i].bitwiseXOR(t))
            return F.array(*[first if j == 0 else other if j == i else v[j] for j in range(n)])

        return step

    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            state = let(state, undo(i, q, p))
        q >>= 1

    def gray(x: Column) -> Column:
        v = pick(x)
        for i in range(1, n):
            v[i] = v[i].bitwiseXOR(v[i - 1])
        t = F.lit(0)
        q = 1 << (bits - 1)
        while q > 1:
            t = t.bitwiseXOR(F.when(v[n - 1].bitwiseAND(F.lit(q)) != 0, q - 1).otherwise(0))
            q >>= 1
        return F.array(*[a.bitwiseXOR(t) for a in v])

    def join(x: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(x[i], b).bitwiseAND(F.lit(1)).cast("long"))
        return out

    return let(let(state, gray), join)


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", dims: tuple[str, ...] = ("source", "lang"), shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard, curve) of every row; dims beside size and key."""
    raw = F.col(f"`{text}`")
    rows = docs.select(
        F.col(f"`{key}`").alias("__key"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"),
        F.xxhash64(raw).alias("__text"),
        *[value_of(docs, d).alias(f"__d{i}") for i, d in enumerate((*dims, key))],
    ).withColumn(f"__d{len(dims) + 1}", F.col("size").cast("double"))
    rows = shared.write_table(rows, "metadata")  # the texts are read once
    n = len(dims) + 2
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    texts = [f"__d{i}" for i in range(n) if rows.schema[f"__d{i}"].dataType.simpleString() == "string"]
    numbers = [f"__d{i}" for i in range(n) if f"__d{i}" not in texts]
    found = rows.agg(F.sum("size").alias("bytes"), *[F.percentile_approx(d, cuts, 10_000).alias(d) for d in numbers]).collect()[0].asDict()
    total = found["bytes"] or 1
    found |= text_cuts(rows, texts, bits) if texts else {}
    axes = []
    for i in range(n):
        cell = F.lit(0)
        for c in found[f"__d{i}"] or []:  # 2**bits - 1 values
            cell = cell + F.when(F.col(f"__d{i}") > F.lit(c), 1).otherwise(0)
        axes.append(cell)
    curve = hilbert_index(axes, bits)
    fine = F.shiftleft(F.col("curve"), TEXT_BITS + KEY_BITS)
    fine = fine + F.shiftleft(F.pmod(F.col("__text"), F.lit(1 << TEXT_BITS)).cast("long"), KEY_BITS) + F.pmod(F.xxhash64("__key"), F.lit(1 << KEY_BITS)).cast("long")
    block_bits = max(0, bits * n + TEXT_BITS + KEY_BITS - 12)
    metadata = rows
    rows = rows.withColumn("curve", curve).withColumn("cell", fine).select("__key", "size", "text_crc32", "__text", "curve", "cell")
    rows = shared.write_table(rows, "curve")  # the curve is computed once
    shared.drop_table(metadata)
    cells = rows.groupBy("cell").agg(F.sum("size").alias("b"), F.count("*").alias("c")).withColumn("block", F.shiftright("cell", block_bits))
    blocks = cells.groupBy("block").agg(F.sum("b").alias("bb"), F.sum("c").alias("bc"))
    over = Window.orderBy("block")  # at most 2**12 blocks
    blocks = blocks.select("block", (F.sum("bb").over(over) - F.col("bb")).alias("b0"), (F.sum("bc").over(over) - F.col("bc")).alias("c0"))
    inside = Window.partitionBy("block").orderBy("cell")
    cells = (
        cells.join(F.broadcast(blocks), "block")
        .select("cell", (F.col("b0") + F.sum("b").over(inside) - F.col("b")).alias("b0"), (F.col("c0") + F.sum("c").over(inside) - F.col("c")).alias("c0"))
    )
    run = Window.partitionBy("cell").orderBy("curve", "__text", "__key", "size")
    ranked = rows.join(cells.hint("merge"), "cell").select(
        "__key",
        "size",
        "text_crc32",
        "curve",
        (F.col("b0") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2).alias("middle"),
        (F.col("c0") + F.row_number().over(run) - 1).alias("rank"),
    )
    placed = ranked.withColumn("shard", F.least(F.floor(F.col("middle") * shards / F.lit(float(total))).cast("int"), F.lit(shards - 1)))
    starts = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # as many rows as shards
    out = placed.join(F.broadcast(starts), "shard").select(
        F.col("__key").alias(key),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
    return shared.reads(out, rows)
