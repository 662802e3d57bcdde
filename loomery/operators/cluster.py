"""Density clustering of values by cosine distance, in overlapping blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.operators import graph
from loomery.operators.skewed import split_join
from loomery.sources.rounds import settled

_SLACK = 1e-6  # radians, beyond what rounding can do to an angle
TILES = 16  # a block's residents are dealt to at most so many tiles, so a vector has a bounded number of copies
_TILE_NUMBERS = 8_000_000  # unless a tile would hold more numbers than these, 64 MB


class Cover:
    """Blocks of unit vectors around pivots. A vector lives in the block of its nearest pivot. Two vectors within an angle
    ``reach`` meet in the later of their two blocks, where the other one visits: by the triangle inequality it is no farther
    from that pivot than the block's radius and ``reach``, nor farther than from its own pivot and twice ``reach``. No
    near pair is lost, however the pivots lie; where vectors form clusters, few blocks are visited."""

    def __init__(self, pivots: np.ndarray, reach: float):
        self.pivots, self.reach, self.radius = pivots, reach, np.zeros(len(pivots))

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.pivots.T, -1, 1))

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        angle = self.angles(x)
        home = angle.argmin(1)
        return home, angle[np.arange(len(x)), home]

    def blocks(self, x: np.ndarray, home: np.ndarray) -> list[np.ndarray]:
        """The block of each vector and the later ones that it visits."""
        angle = self.angles(x)
        far = np.minimum(self.radius + self.reach, angle[np.arange(len(x)), home][:, None] + 2 * self.reach) + _SLACK
        at = np.arange(len(self.pivots))
        return [np.flatnonzero((a <= f) & (at > h) | (at == h)) for a, f, h in zip(angle, far, home, strict=True)]


def _unit(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of equal length, none of them null."""
    x = (vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors).flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cover(points: DataFrame, reach: float, size: int, most: int = 1024) -> tuple[Cover, DataFrame]:
    """Blocks for ``points`` (id, vec, h), about ``size`` to a block, and (id, vec, home). The pivots are the at most
    ``most`` points of least ``h``; the driver sees them and the radius of each block."""
    k = min(most, max(1, -(-points.count() // size)))
    found = Cover(np.array([r.vec for r in points.orderBy("h").limit(k).collect()], float), reach)
    found.pivots /= np.linalg.norm(found.pivots, axis=1, keepdims=True)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            home, angle = found.home(_unit(batch.column(1))) if batch.num_rows else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(angle)], ["id", "vec", "home", "angle"])

    placed = settled(points.select("id", "vec").mapInArrow(run, "id long, vec array<double>, home int, angle double"))
    for r in placed.groupBy("home").agg(F.max("angle").alias("angle")).collect():
        found.radius[r.home] = r.angle
    return found, placed.drop("angle")


def tiles(n: Column | int, tile: int, d: int) -> Column:
    """To how many tiles ``n`` rows of ``d`` numbers are dealt: some ``tile`` to each, but no more than TILES as long as these
    are of bounded size."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.greatest(F.least(F.ceil(n / tile), F.lit(TILES)), F.ceil(n / max(tile, _TILE_NUMBERS // max(d, 1)))).cast("int")


def visits(points: DataFrame, blocks: Cover) -> DataFrame:
    """``points`` (id, vec, home, ..) with all the ``blocks`` in which each stands."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            home = batch.column("home").to_numpy()
            at = blocks.blocks(_unit(batch.column("vec")), home) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32()))], [*batch.schema.names, "blocks"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(run, f"{kinds}, blocks array<int>")


def thrifty(points: DataFrame, blocks: Cover, tile: int, d: int) -> tuple[Cover, DataFrame]:
    """The cover and (id, vec, home), if it makes few copies of a vector; else one block of all. Where vectors form no
    clusters, each visits most blocks, and copies would grow with their number."""
    at = visits(points, blocks).select("home", F.explode("blocks").alias("block"))
    sizes = at.groupBy("block").agg(F.count_if(F.col("home") == F.col("block")).alias("own"), F.count_if(F.col("home") != F.col("block")).alias("guests"))
    own, guests = tiles(F.col("own"), tile, d), tiles(F.col("guests"), tile, d)
    dealt = sizes.agg(F.sum("own"), F.sum(F.col("own") * (own + guests + 1) + F.col("guests") * own)).first()
    if not dealt[0] or dealt[1] <= TILES * dealt[0]:
        return blocks, points
    one = Cover(blocks.pivots[:1], blocks.reach)
    one.radius[:] = np.pi
    return one, points.withColumn("home", F.lit(0))


def meet(points: DataFrame, blocks: Cover, eps: float, work: Callable, schema: str, tile: int = 2048, strip: int = 2048) -> DataFrame:
    """What ``work`` makes of each two tiles of a block: its residents by all that are there, each two tiles of residents
    once. ``points``: id, vec, home and two numbers w and c. ``work`` gets two lists of (id, w, c), for which of the second
    it is to tell something too, and the places (i, j) of near pairs; nobody is near to oneself. Large tiles meet in strips,
    so that no matrix is large; ``work`` is called for each two of them, and at the end for what it made of them."""
    single, d = len(blocks.pivots) == 1, blocks.pivots.shape[1]
    there = points.select("id", "vec", "home", F.col("w").cast("long").alias("w"), F.col("c").cast("long").alias("c"))
    there = there.withColumn("block", F.lit(0)) if single else visits(there, blocks).select("id", "vec", "home", "w", "c", F.explode("blocks").alias("block"))
    guest = F.col("home") != F.col("block")
    counted = there.groupBy("block").agg(F.count_if(~guest).alias("own"), F.count_if(guest).alias("guests"))
    sizes = settled(counted.select("block", tiles(F.col("own"), tile, d).alias("own"), tiles(F.col("guests"), tile, d).alias("more")))
    dealt = there.join(F.broadcast(sizes), "block").where("own > 0")  # a row for each pivot
    at = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    row = dealt.withColumn("t", F.when(guest, F.col("own") + at(F.col("more"))).otherwise(at(F.col("own"))))
    side = lambda p, q, s: F.struct(p.alias("p"), q.alias("q"), F.lit(s).alias("side"))
    t, last = F.col("t"), F.col("own") + F.col("more") - 1
    rows = F.transform(F.sequence(t, last), lambda q: side(t, q, 0))
    columns = F.transform(F.sequence(F.lit(0), F.least(t, F.col("own") - 1)), lambda p: side(p, t, 1))
    placed = row.select("block", "id", "vec", "home", "w", "c", F.explode(F.when(guest, columns).otherwise(F.concat(rows, columns))).alias("x")).select("block", "x.*", "id", "vec", "home", "w", "c")
    bound = 1 - eps if eps >= 0 else np.inf

    def task(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        a, b = (table.filter(pa.array(side == s)) for s in (0, 1))
        if not a.num_rows or not b.num_rows:
            return made.empty_table()
        told = (b["home"].to_numpy() != b["block"].to_numpy()) | (table["p"][0].as_py() != table["q"][0].as_py())
        x, y = _unit(a["vec"]), _unit(b["vec"])
        mine, theirs = ([t[c].to_numpy() for c in ("id", "w", "c")] for t in (a, b))
        out = []
        for r in range(0, len(x), strip):
            for c in range(0, len(y), strip):
                i, j = np.nonzero(x[r : r + strip] @ y[c : c + strip].T >= bound)
                one, two = ([v[k : k + strip] for v in of] for of, k in ((mine, r), (theirs, c)))
                apart = one[0][i] != two[0][j]
                out.append(work.found(one, two, told[c : c + strip], i[apart], j[apart]))
        columns = [np.concatenate(v) for v in zip(*out, strict=True)]
        return pa.Table.from_arrays([pa.array(v, pa.int64()) for v in (work.joined(*columns) if len(out) > 1 else columns)], schema=made)

    made = pa.schema([(part.split()[0], pa.int64()) for part in schema.split(", ")])
    return placed.groupBy("block", "p", "q").applyInArrow(task, schema)


class _Weights:
    """(id, k): how many are near to each."""

    @staticmethod
    def found(a: list[np.ndarray], b: list[np.ndarray], told: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        k = np.r_[np.bincount(i, b[1][j], len(a[0])), np.bincount(j, a[1][i], len(b[0])) * told].astype(np.int64)
        return np.r_[a[0], b[0]][k > 0], k[k > 0]

    @staticmethod
    def joined(ids: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, ...]:
        each, at = np.unique(ids, return_inverse=True)
        return each, np.bincount(at, k, len(each)).astype(np.int64)


class _Links:
    """(a, b): links that join all that the near pairs join."""

    @staticmethod
    def found(a: list[np.ndarray], b: list[np.ndarray], told: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        return _Links.joined(a[0][i], b[0][j])

    @staticmethod
    def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        ids, at = np.unique(np.r_[a, b], return_inverse=True)
        kept = graph.spanning(len(ids), at[: len(a)], at[len(a) :])
        return a[kept], b[kept]


class _Lowest:
    """(id, reach): for each without a cluster (c < 0) the lowest cluster near to it."""

    @staticmethod
    def found(a: list[np.ndarray], b: list[np.ndarray], told: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        one, two = (a[2][i] < 0) & (b[2][j] >= 0), (b[2][j] < 0) & (a[2][i] >= 0) & told[j]
        return _Lowest.joined(np.r_[a[0][i[one]], b[0][j[two]]], np.r_[b[2][j[one]], a[2][i[two]]])

    @staticmethod
    def joined(ids: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, ...]:
        each, at = np.unique(ids, return_inverse=True)
        least = np.full(len(each), np.iinfo(np.int64).max)
        np.minimum.at(least, at, reach)
        return each, least


def numbered(keys: DataFrame, key: str) -> DataFrame:
    """(key, nth): distinct keys numbered from 0 in order. Ranges of keys are numbered each by itself; the driver adds up
    the sizes of the ranges only."""
    ranged = settled(keys.select(key).repartitionByRange(key).withColumn("part", F.spark_partition_id()))
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy("part").count().collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    if not starts:
        return keys.select(key, F.lit(0).cast("long").alias("nth"))
    before = F.create_map(*(F.lit(x) for part, n in starts for x in (part, n)))[F.col("part")]
    return ranged.select(key, (before + F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1).cast("long").alias("nth"))


def density_clusters(points: DataFrame, eps: float = 0.2, least: int = 2, size: int = 1024, tile: int = 2048) -> DataFrame:
    """(id, cluster): points with ``least`` neighbours, themselves included, are cores; cores within ``eps`` are one
    cluster; other points take the lowest cluster of a neighbouring core, or -1. Clusters are numbered by least core id.

    Exact, in overlapping blocks (``Cover``), or in one block of all where these would copy too much; each is dealt in a bounded
    number of tiles, so what is exchanged grows with the points, though each two are compared where none can be left out. Neighbours are counted where they meet; of links between
    cores each task hands on a spanning forest, so a dense cluster makes no rows in the square of its size. Points with equal
    vectors are one point of their number. Near to none: zero and null vectors, those with null or undefined components,
    and those of another length than the most frequent one."""
    plain = points.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    sound = F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    length = plain.where(sound).groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    fit = F.coalesce(sound & (F.size("vec") == (length[0].d if length else 0)), F.lit(False))
    same = F.struct("vec", F.when(~fit, F.col("id")).alias("alone"))
    keyed = settled(plain.withColumn("fit", fit).withColumn("h", F.xxhash64(same)).withColumn("m", F.md5(F.to_json(same))))
    one = settled(keyed.groupBy("h", "m", "fit").agg(F.min("id").alias("lead"), F.count("*").alias("n"), F.min_by("vec", "id").alias("vec")))
    leads = one.where("fit").select(F.col("lead").alias("id"), "vec", "h")
    weight = one.select(F.col("lead").alias("id"), "n")
    if length:
        blocks, placed = cover(leads, float(np.arccos(np.clip(1 - eps, -1, 1))), size)
        blocks, placed = thrifty(placed, blocks, tile, length[0].d)
        placed = settled(placed.join(weight, "id"))
        around = meet(placed.select("id", "vec", "home", F.col("n").alias("w"), F.lit(0).alias("c")), blocks, eps, _Weights, "id long, k long", tile).groupBy("id").agg(F.sum("k").alias("k"))
        known = settled(weight.join(around, "id", "left").withColumn("k", F.coalesce("k", F.lit(0))))
        cores = known.where(F.col("k") + F.col("n") >= least).select("id")
        links = meet(placed.join(cores, "id", "left_semi").select("id", "vec", "home", F.lit(0).alias("w"), F.lit(0).alias("c")), blocks, eps, _Links, "a long, b long", tile)
    else:
        cores = weight.where(F.col("n") >= least).select("id")
        links = cores.select(F.col("id").alias("a"), F.col("id").alias("b"))
    labels = settled(graph.components(links.union(cores.select(F.col("id").alias("a"), F.col("id").alias("b")))))
    ranks = numbered(labels.select("component").distinct(), "component")
    cored = settled(split_join(labels, ranks, "component", F.col("id")).select("id", F.col("nth").alias("cluster")))
    found = weight.select("id").join(cored, "id", "left")
    if length:
        edge = known.where(F.col("k") > 0).select("id").join(cored, "id", "left_anti").select("id", F.lit(-1).cast("long").alias("cluster"))
        if not edge.isEmpty():
            border = meet(placed.join(cored.union(edge), "id").select("id", "vec", "home", F.lit(0).alias("w"), F.col("cluster").alias("c")), blocks, eps, _Lowest, "id long, reach long", tile).groupBy("id").agg(F.min("reach").alias("reach"))
            found = found.join(border, "id", "left").select("id", F.coalesce("cluster", "reach").alias("cluster"))
    of_lead = one.select("h", "m", F.col("lead").alias("id")).join(found, "id").select("h", "m", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return split_join(keyed.select("id", "h", "m"), of_lead, ["h", "m"], F.col("id")).select("id", "cluster")
