"""Near-duplicate vectors by PCA-ordered tiled comparison.

Unit vectors are turned into the principal axes of all of them, which keeps their products and puts most of each product
into the leading dimensions. Vectors of one label are dealt into tiles along the first axis, and tiles that are too far
apart there cannot hold links. For two tiles, products are summed over leading dimensions; what the others can add is at most
the product of the two vectors' suffix norms, so a pair ends as soon as its sum and that bound stay below the threshold.
Turning rounds, so pairs whose whole sum is within ``SLACK`` of the threshold are decided by the cosine of the vectors as given.

Every pair of tiles is a task of its own, and vectors, turned and as given, are shuffled once for each tile of their label
that is near enough. Tiles are as large as a task's memory allows, so a label needs few of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from quire.llm.graph import components
from quire.llm.shared import written

#: Vectors of a tile, about, and the bytes that they may have.
TILE = 8192
TILE_BYTES = 16 << 20
#: Rows of a tile that are compared with another tile at a time.
STRIP = 256
GRID = 128
SLACK = 1e-9


def unit_vectors(classes: DataFrame) -> DataFrame:
    """``classes`` (with vectors ``v``) with ``d``, their length, ``u``, the unit vector, and ``w``, the vector as given but for a
    power of two, instead of ``v``. That power brings the largest component to 1 or so and rounds nothing, so that norms
    neither overflow nor vanish."""
    keep = [c for c in classes.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.num_columns - 1)
            at = np.asarray(vectors.offsets)
            x = vectors.values.to_numpy()[at[0] : at[-1]]
            at = at - at[0]
            given = x
            if len(x):
                d = np.diff(at)
                given = np.ldexp(x, -np.repeat(np.frexp(np.maximum.reduceat(np.abs(x), at[:-1]))[1], d))
                x = given / np.repeat(np.sqrt(np.add.reduceat(given * given, at[:-1])), d)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(y, pa.float64())) for y in (x, given)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(at), pa.int64()), *lists], [*keep, "d", "u", "w"])

    schema = StructType([*(classes.schema[c] for c in keep), StructField("d", LongType()), *(StructField(c, ArrayType(DoubleType())) for c in ("u", "w"))])
    return classes.select(*keep, "v").mapInArrow(run, schema)


def principal_axes(units: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension count, an orthogonal matrix whose columns are the axes, widest first, of ``d, u`` (unit vectors).
    Tasks add up their own second moments; d*d numbers for each d reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                x = batch.column(1).filter(pa.array(dims == d)).values.to_numpy().reshape(-1, d)
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d)), pa.array(np.arange(d * d)), pa.array(m.ravel())], ["d", "i", "v"])

    out: dict[int, np.ndarray] = {}
    for d, i, v in units.select("d", "u").mapInArrow(run, "d long, i long, v double").groupBy("d", "i").agg(F.sum("v")).collect():
        out.setdefault(d, np.zeros(d * d))[i] = v
    return {d: np.linalg.eigh((m.reshape(d, d) + m.reshape(d, d).T) / 2)[1][:, ::-1].copy() for d, m in out.items()}


def turned(units: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """``units`` with ``p``, the coordinates along the axes."""
    keep = units.columns
    at = keep.index("u"), keep.index("d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vectors = batch.column(at[1]).to_numpy(), batch.column(at[0])
            parts: list[np.ndarray] = [np.empty(0)] * batch.num_rows
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                turned_rows = vectors.take(pa.array(rows)).values.to_numpy().reshape(-1, d) @ axes[d]
                for r, x in zip(rows.tolist(), turned_rows, strict=True):
                    parts[r] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.float64()))], [*keep, "p"])

    return units.mapInArrow(run, StructType([*units.schema.fields, StructField("p", ArrayType(DoubleType()))]))


def stages(d: int) -> list[tuple[int, int]]:
    """Runs of dimensions that are added one after the other."""
    cuts = sorted({0, min(d, 8), min(d, 24), d})
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, sums in the order of components."""
    product = [np.add.accumulate(x * y, axis=1)[:, -1] for x, y in ((a, b), (a, a), (b, b))]
    return product[0] / (np.sqrt(product[1]) * np.sqrt(product[2]))


def linked(a: np.ndarray, b: np.ndarray, given_a: np.ndarray, given_b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of two blocks of turned unit vectors whose product is ``least`` or more, strip by strip; near it the cosine of
    the given vectors decides."""
    d = a.shape[1]
    norms = [(np.sqrt((a[:, z:] ** 2).sum(axis=1)), np.sqrt((b[:, z:] ** 2).sum(axis=1))) for _, z in stages(d)]
    for s in range(0, len(a), STRIP):
        block = a[s : s + STRIP]
        for k, ((lo, hi), (na, nb)) in enumerate(zip(stages(d), norms, strict=True)):
            if k == 0:
                total = block[:, lo:hi] @ b[:, lo:hi].T
                i, j = np.nonzero(total + np.outer(na[s : s + STRIP], nb) >= least - SLACK)
                total = total[i, j]
            elif len(i):
                total = total + np.einsum("ij,ij->i", block[i, lo:hi], b[j, lo:hi])
                stay = total + na[s + i] * nb[j] >= least - SLACK
                i, j, total = i[stay], j[stay], total[stay]
        reach = total >= least
        near = np.flatnonzero(np.abs(total - least) <= SLACK)
        for k in range(0, len(near), STRIP * 16):
            some = near[k : k + STRIP * 16]
            reach[some] = cosines(given_a[s + i[some]], given_b[j[some]]) >= least
        yield i[reach] + s, j[reach]


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges row-column that connect what a boolean matrix of links connects, no more than needed."""
    rows, cols, out = links.any(axis=1), links.any(axis=0), []
    for r in np.flatnonzero(rows).tolist():
        if not rows[r]:
            continue
        rows[r] = False
        front = np.array([r])
        while len(front):
            hit = np.flatnonzero(links[front].any(axis=0) & cols)
            out += zip(front[links[np.ix_(front, hit)].argmax(axis=0)].tolist(), hit.tolist(), strict=True)
            cols[hit] = False
            back = np.flatnonzero(links[:, hit].any(axis=1) & rows) if len(hit) else hit
            out += zip(back.tolist(), hit[links[np.ix_(back, hit)].argmax(axis=1)].tolist(), strict=True) if len(back) else ()
            rows[back] = False
            front = back
    return out


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, tile: int = TILE) -> DataFrame:
    """``<id>, n_links, component_id, kept``, one row per row of ``vectors``.

    Two vectors of one label and one length are linked when their cosine, in double precision, is ``least`` or more.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id reachable, itself included.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or id, link with
    nothing. Equal vectors of one label are one class that is compared once; repeated rows count as linked rows. Rows that
    share an id but not the label or vector are linked each by its own. Ties at the threshold are links: the cosine there is
    that of the given vectors, in doubles, summed in the order of their components. An empty table gives no rows. Other columns are not read.
    """
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    top = F.array_max(F.transform("v", F.abs))
    usable = F.when(sound, top > 0).otherwise(F.lit(False))
    # Classes of equal vectors by 128 bits of label and vector; a class is known by the number of one of its rows.
    keys = {f"h{i}": F.xxhash64(F.lit(i), "label", "v") for i in (1, 2)}
    rows = written(x.withColumn("ok", usable).withColumn("v", F.when(F.col("ok"), F.col("v"))).withColumns(keys).withColumn("row", F.monotonically_increasing_id()), "vectors")
    good = rows.where("ok")
    classes = written(good.groupBy("h1", "h2").agg(F.min(F.struct("id", "row")).alias("x"), F.count("*").alias("m")).select("h1", "h2", F.col("x.row").alias("rep"), F.col("x.id").alias("least_id"), "m"), "classes")
    units = written(unit_vectors(good.join(classes.select("rep", "m"), good.row == F.col("rep")).select("rep", "label", "m", "v")), "units")
    placed = written(turned(units, principal_axes(units)).drop("u").withColumn("x", F.element_at("p", 1)), "turned")
    # Tiles: ranges along the first axis, and where too many vectors share a range, shares of it by hash.
    quantiles = F.percentile_approx("x", F.array(*(F.lit(i / GRID) for i in range(1, GRID))), F.lit(2000))
    of = placed.groupBy("label", "d").agg(F.count("*").alias("n"), quantiles.alias("q"))
    share = F.aggregate("q", F.lit(0), lambda t, c: t + (F.col("x") > c).cast("int"))
    room = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.lit(TILE_BYTES) / (16 * F.col("d")))))
    tiles = placed.join(written(of, "labels"), ["label", "d"]).withColumn("range", F.floor(share * F.least(F.ceil(F.col("n") / room), F.lit(GRID)) / GRID))
    full = written(tiles.groupBy("label", "d", "range").agg(F.count("*").alias("c")), "ranges")
    tiles = tiles.join(full, ["label", "d", "range"]).withColumn("tile", F.col("range") * (1 << 32) + F.pmod(F.xxhash64("rep"), F.ceil(F.col("c") / room)))
    tiles = written(tiles.select("label", "d", "tile", "rep", "m", "x", "p", "w"), "tiles")
    spans = tiles.groupBy("label", "d", "tile").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    # Unit vectors with cosine c are sqrt(2 - 2c) apart, and so are at most their first coordinates.
    gap = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    a, b = spans.alias("a"), spans.alias("b")
    near = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.d") == F.col("b.d")) & (F.col("a.tile") <= F.col("b.tile")) & (F.col("b.lo") - F.col("a.hi") <= gap) & (F.col("a.lo") - F.col("b.hi") <= gap))
    near = near.select("a.label", "a.d", F.col("a.tile").alias("t"), F.col("b.tile").alias("o"))
    sides = near.select("label", "d", "t", "o", F.col("t").alias("tile")).union(near.where("t <> o").select("label", "d", "t", "o", F.col("o").alias("tile")))
    dealt = tiles.join(sides, ["label", "d", "tile"]).select("label", "d", "t", "o", "tile", "rep", "m", "p", "w")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        d, t, o = (key[i].as_py() for i in (1, 2, 3))
        group = group.combine_chunks()
        side = group["tile"].to_numpy()
        ids, m = group["rep"].to_numpy(), group["m"].to_numpy()
        p, w = (group[c].combine_chunks().flatten().to_numpy().reshape(-1, d) for c in ("p", "w"))
        left, right = np.flatnonzero(side == t), np.flatnonzero(side == o)
        links = np.zeros((len(left), len(right)), dtype=bool)
        for i, j in linked(p[left], p[right], w[left], w[right], least):
            links[i, j] = True
        if t == o:
            np.fill_diagonal(links, False)
        edges = forest(links)
        # Strip by strip: products with counts take eight bytes for each link.
        strips = range(0, len(left), STRIP)
        by_row = np.concatenate([links[s : s + STRIP] @ m[right] for s in strips]) if len(left) else left
        counts = {int(ids[left[i]]): int(n) for i, n in enumerate(by_row) if n}
        if t != o:
            by_column = sum((m[left[s : s + STRIP]] @ links[s : s + STRIP] for s in strips), np.zeros(len(right), np.int64))
            for j, n in enumerate(by_column):
                if n:
                    counts[int(ids[right[j]])] = int(n)
        e = [(int(ids[left[i]]), int(ids[right[j]])) for i, j in edges]
        return pa.table({"a": pa.array([*counts, *(x for x, _ in e)], pa.int64()), "b": pa.array([*[None] * len(counts), *(y for _, y in e)], pa.int64()), "n": pa.array([*counts.values(), *[0] * len(e)], pa.int64())})

    found = written(dealt.groupBy("label", "d", "t", "o").applyInArrow(compare, "a long, b long, n long"), "found")
    labels = components(found.where("b is not null"))
    counts = found.groupBy("a").agg(F.sum("n").alias("links"))
    known = classes.join(counts, classes.rep == counts.a, "left").join(labels, classes.rep == labels.node, "left")
    known = known.select("h1", "h2", "least_id", F.coalesce("label", "rep").alias("part"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    smallest = written(known.groupBy("part").agg(F.min("least_id").alias("component_id")), "smallest")
    known = written(known.join(smallest, "part").select("h1", "h2", "n_links", "component_id"), "known")
    out = good.select("id", "h1", "h2").join(known, ["h1", "h2"]).select("id", "n_links", "component_id").unionByName(rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))
