"""Embedding near-dedup by sorted projection passes.

In each pass, the vectors of a label are put in lexicographic order of the concatenated signs of BITS random
projections (ties in random order) and cut into blocks; every block is compared with itself and the
next one, in double precision, a block pair to a task.  Tasks return one edge a vector (its local root), never
pairs; all passes are united by connected components.

The number of passes follows from the largest label, by one rule at every size and without a cap, so that a pair at the threshold agrees in the first bits
(a cell) of some pass with probability 1 - MISS at least.  A cell of at most a block lies within two neighbouring blocks.
In a larger one (a group of near copies, or vectors that lean to one side), every vector outside
the cell's commonest component is compared with the whole cell, so each pair that agrees is compared or
already connected, however the vectors lie.

Links never leave a component, so n_links is counted exactly afterwards, over all pairs of each component: small
components share tasks, large ones run as a grid of tiles.  Exact copies are folded into one vector with a weight first.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors without label, link with
nothing (n_links 0, component their own id, kept); vectors of different length don't link; an id that
occurs more than once counts once, with its least (label, vector); a null id gives a row of nulls with no
links; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caduspark.llm import shared

BLOCK, BITS, MISS = 1_024, 24, 1e-4
#: Side, in blocks, of the tiles in which large cells and components are compared.
TILE = 4


def cell_bits(largest: int, block: int) -> int:
    """Leading bits of a key that make a cell: about half a block of the largest label, if it is spread evenly."""
    return max(1, math.ceil(math.log2(max(largest, 1) / block)) + 1)


def passes_for(largest: int, threshold: float, block: int) -> int:
    """Passes after which a pair at the threshold has agreed in a whole cell with probability 1 - MISS; one rule for every size."""
    same = 1 - math.acos(threshold) / math.pi
    bits = cell_bits(largest, block)
    return max(2, math.ceil(math.log(MISS) / math.log1p(-(same**bits))))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(float).reshape(len(column), -1)


def _units(table: pa.Table) -> np.ndarray:
    x = _matrix(table.column("vector"))
    return x / np.sqrt((x * x).sum(1))[:, None]


def _signs(passes: int, seed: int):
    """rows (id, label, dim, vector) -> keys of all passes."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.Generator(np.random.PCG64([seed, int(dim)])).normal(size=(dim, passes * BITS))
                bits = (_matrix(part.column(3)) @ planes[dim] > 0).reshape(len(part), passes, BITS)
                keys = bits @ (1 << np.arange(BITS - 1, -1, -1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * passes, pa.int32()), pa.array(keys.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], names=["rep", "label", "dim", "keys"])

    return run


def _ranked(keys: DataFrame, block: int, spare: int) -> DataFrame:
    """(rep, blocks of all passes, cells: keys without their last `spare` bits): exact ranks in every (label, dim, pass), from sums over bounded groups."""
    rows = keys.select("rep", "label", "dim", F.posexplode("keys").alias("pass", "key"))
    rows = rows.withColumn("tie", F.xxhash64("rep", "pass")).withColumn("cell", F.shiftleft("key", 6).bitwiseOR(F.pmod("tie", F.lit(64))))
    of = ["label", "dim", "pass"]
    cells = rows.groupBy(*of, "cell").agg(F.count("*").alias("n")).withColumn("coarse", F.shiftright("cell", 18))
    coarse = cells.groupBy(*of, "coarse").agg(F.sum("n").alias("n"))
    coarse = coarse.select(*of, "coarse", (F.sum("n").over(Window.partitionBy(*of).orderBy("coarse")) - F.col("n")).alias("c0"))
    cells = cells.join(coarse, [*of, "coarse"]).select(
        *of, "cell", (F.col("c0") + F.sum("n").over(Window.partitionBy(*of, "coarse").orderBy("cell")) - F.col("n")).alias("c0")
    )
    place = F.col("c0") + F.row_number().over(Window.partitionBy(*of, "cell").orderBy("tie", "rep")) - 1
    rows = rows.join(cells.hint("merge"), [*of, "cell"]).select("rep", "pass", F.floor(place / block).cast("int").alias("block"), F.shiftright("key", spare).alias("at"))
    turns = rows.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("pass", "block", "at"))).alias("turns"))
    return turns.select("rep", F.col("turns.block").alias("blocks"), F.col("turns.at").alias("cells"))


def linked(x: np.ndarray, y: np.ndarray | None, threshold: float):
    """Index pairs of linked unit vectors, rows of x against rows of y (None: x itself, each pair once), in strips."""
    for start in range(0, len(x), BLOCK):
        if y is None:
            a, b = np.nonzero(np.triu(x[start : start + BLOCK] @ x[start:].T >= threshold, 1))
            yield a + start, b + start
        else:
            a, b = np.nonzero(x[start : start + BLOCK] @ y.T >= threshold)
            yield a + start, b


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each one's component."""
    root = np.arange(n)
    while len(a):  # label propagation with jumps: a few vectorised rounds
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _edges(threshold: float):
    """Edges to local roots: home rows with each other (far = 0) or with the guests."""

    def run(table: pa.Table) -> pa.Table:
        far = table.column("far")[0].as_py()
        guest = np.asarray(table.column("guest"))
        home, other = table.filter(pa.array(~guest)), table.filter(pa.array(guest))
        a, b = np.empty(0, int), np.empty(0, int)
        ids, at = np.unique(np.concatenate([np.asarray(home.column("rep")), np.asarray(other.column("rep"))]), return_inverse=True)
        if len(home) and (len(other) or not far):
            strips = linked(_units(home), _units(other) if far else None, threshold)
            for x, y in strips:  # one strip's pairs at a time, reduced to an edge a vector
                x, y = at[: len(home)][x], (at[len(home) :] if far else at)[y]
                root = roots(len(ids), np.concatenate([a, x]), np.concatenate([b, y]))
                a = np.flatnonzero(root != np.arange(len(ids)))
                b = root[a]
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    return run


def _counts(threshold: float):
    """Links of one tile: pairs of one component among the home rows (i = j) or of home rows and guests."""

    def run(table: pa.Table) -> pa.Table:
        guest = np.asarray(table.column("guest"))
        home, other = table.filter(pa.array(~guest)), table.filter(pa.array(guest))
        sides = [home] if table.column("i")[0].as_py() == table.column("j")[0].as_py() else [home, other]
        ids, weight, group = ([np.asarray(t.column(c)) for t in sides] for c in ("rep", "weight", "component"))
        n = [np.zeros(len(t)) for t in sides]
        if all(len(t) for t in sides):
            for a, b in linked(_units(home), _units(other) if len(sides) == 2 else None, threshold):
                one = group[0][a] == group[-1][b]
                a, b = a[one], b[one]
                n[0] += np.bincount(a, weight[-1][b], len(n[0]))
                n[-1] += np.bincount(b, weight[0][a], len(n[-1]))
        return pa.table({"rep": pa.array(np.concatenate(ids), pa.int64()), "n": pa.array(np.concatenate(n).astype(np.int64), pa.int64())})

    return run


def _tiles(size: Column, side: int) -> Column:
    return F.ceil(size / side).cast("int")


def _tile(tiles: Column) -> Column:
    return F.pmod(F.xxhash64("rep"), tiles).cast("int")


def _count_links(reps: DataFrame, components: DataFrame, threshold: float, block: int) -> DataFrame:
    """(rep, n): links with other vectors, over all pairs of each component."""
    sizes = components.groupBy("component").agg(F.count("*").alias("m"))
    total = components.count()
    large = sizes.where(F.col("m") > block)
    rows = components.join(large, "component", "left").select(F.col("node").alias("rep"), "component", "m")
    tiles = F.coalesce(_tiles(F.col("m"), TILE * block), F.lit(1))
    shared_by = F.pmod(F.xxhash64("component"), F.lit(max(1, math.ceil(total / block))))
    rows = rows.select("rep", "component", F.col("m").isNotNull().alias("large"), F.when(F.col("m").isNull(), shared_by).otherwise(F.col("component")).alias("group"), tiles.alias("tiles"), _tile(tiles).alias("own"))
    rows = rows.join(reps.select("rep", "weight", "dim", "vector"), "rep").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with")).withColumn("guest", F.col("own") > F.col("with"))
    rows = rows.select("rep", "component", "weight", "vector", "guest", "dim", "large", "group", "i", "j")
    return rows.groupBy("dim", "large", "group", "i", "j").applyInArrow(_counts(threshold), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """(key, n_links, component_id, kept) of every vector."""
    shared.tune(vectors.sparkSession)
    raw = F.col(f"`{vector}`")
    fit = raw.isNotNull() & F.col(f"`{label}`").isNotNull() & F.forall(raw, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    fit = fit & F.exists(raw, lambda x: F.coalesce(x != 0, F.lit(False)))
    kind = vectors.schema[label].dataType.simpleString()
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.when(fit, F.struct(F.col(f"`{label}`").alias("label"), raw.alias("vector"))).alias("v"))
    rows = shared.write_table(rows.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    fold = rows.where("id is not null and v is not null").groupBy(F.col("v.label").alias("label"), F.col("v.vector").alias("vector"))
    reps = shared.write_table(fold.agg(F.min("id").alias("rep"), F.count("*").alias("weight")).withColumn("dim", F.size("vector")), "reps")
    largest = reps.groupBy("label", "dim").count().agg(F.max("count")).collect()[0][0] or 0
    passes = passes_for(largest, threshold, block)
    keys = reps.select("rep", "label", "dim", "vector").mapInArrow(_signs(passes, seed), f"rep long, label {kind}, dim int, keys array<long>")
    spare = max(0, BITS - cell_bits(largest, block))
    base = shared.write_table(reps.join(_ranked(keys, block, spare), "rep"), "blocks")
    columns = ("label", "dim", "turn", "far", "block", "tile")

    def turns(rows: DataFrame) -> DataFrame:
        seen = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
        return seen.withColumn("block", F.element_at("blocks", F.col("turn") + 1)).withColumn("cell", F.element_at("cells", F.col("turn") + 1))

    def solve(tasks: DataFrame) -> DataFrame:
        tasks = tasks.select("rep", "vector", "guest", *columns)
        return shared.write_table(tasks.groupBy(*columns).applyInArrow(_edges(threshold), "a long, b long"), "links")

    blocks = turns(base).withColumn("block", F.col("block").cast("long")).withColumn("tile", F.lit(0))
    alone = blocks.withColumn("far", F.lit(0)).withColumn("guest", F.lit(False))
    home = blocks.withColumn("far", F.lit(1)).withColumn("guest", F.lit(False))
    guest = blocks.where("block >= 1").withColumn("block", F.col("block") - 1).withColumn("far", F.lit(1)).withColumn("guest", F.lit(True))
    edges = solve(alone.unionByName(home).unionByName(guest))
    components = shared.connected_components(edges)
    cell = ["label", "dim", "turn", "cell"]
    members = turns(base.select("rep", "label", "dim", "blocks", "cells")).select("rep", *cell)
    large = shared.write_table(members.groupBy(*cell).agg(F.count("*").alias("size")).where(F.col("size") > block), "cells")
    if large.limit(1).count():
        of = base.join(components.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        counted = turns(of.drop("vector")).join(large, cell).groupBy(*cell, "size", "component").agg(F.count("*").alias("n"))
        top = counted.groupBy(*cell, "size").agg(F.max(F.struct("n", "component")).alias("top"))
        top = top.select(*cell, "size", F.col("top.component").alias("most"), (F.col("size") - F.col("top.n")).alias("others")).where("others > 0")
        top = shared.write_table(top, "cells")
        side = TILE * block
        near = turns(of).join(top, cell).withColumn("block", F.col("cell")).withColumn("far", F.lit(1))
        wide, high = _tiles(F.col("size"), side), _tiles(F.col("others"), side)
        each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        home = near.where(F.col("component") != F.col("most")).withColumn("with", each(wide)).withColumn("tile", _tile(high) * wide + F.col("with"))
        guest = near.withColumn("with", each(high)).withColumn("tile", F.col("with") * wide + _tile(wide))
        more = solve(home.withColumn("guest", F.lit(False)).unionByName(guest.withColumn("guest", F.lit(True))))
        shared.release(components)
        components = shared.connected_components(edges.unionByName(more))
        shared.drop_table(more)
        shared.drop_table(top)
    for table in (base, edges, large):
        shared.drop_table(table)
    counts = _count_links(reps, components, threshold, block)
    of_rep = (
        reps.join(counts, "rep", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "vector", "rep", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    )
    out = rows.join(of_rep, (rows["v.label"] == of_rep["label"]) & (rows["v.vector"] == of_rep["vector"]) & rows["id"].isNotNull(), "left")
    out = out.select(
        F.col("id").alias(key),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", "id").alias("component_id"),
        (F.coalesce("c", "id") == F.col("id")).alias("kept"),
    )
    return shared.reads(out, rows, reps, *components._reads)
