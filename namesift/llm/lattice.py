"""Near-duplicate embeddings: lattice hashing in E8, neighbouring cells, cosines verified in double precision.

In each of TABLES tables a vector's direction is projected at random to BLOCKS times eight numbers, and each eight are
decoded to the nearest point of the lattice E8: together they name a cell. Besides its home cell a vector is shown in
the PROBES neighbouring cells nearest to it, one lattice step (of 240) away in one block. Vectors at home in a cell
meet all that are at home or shown there. Equal vectors are one before that. What meets is compared in blocks of
bounded size inside tasks; a pair that would meet several times counts at its first meeting alone, which both vectors'
cells tell, so no pair is ever a row. A block gives each vector its number of links and one link to a member of its part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesift.llm.common import materialise
from namesift.llm.neardup import components

TABLES, BLOCKS, PROBES = 8, 2, 5
#: Side of a lattice cell against the length 1 of the vectors, each projected number having variance 1.
WIDTH = 2.6
#: Entries of a cell that are compared as one block; a cell with more is dealt out in blocks that meet two by two.
CELL_ROWS = 2048
#: Salts that the rows of a large cell or of many equal vectors are dealt out by.
SALTS = 16
#: Cosines that one comparison of small cells makes at once, and rows taken together for it.
AT_ONCE, ROWS = 1 << 20, 8192
SEED = 20240811


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or all of a half with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest point with whole entries of even sum: rounded, where the sum is odd the worst entry the other way."""
    near = np.rint(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(rest[odd]).argmax(1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """The point of E8 nearest to each row of eight numbers."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Lattice:
    """The projections of all tables for vectors of `dims` entries."""

    def __init__(self, dims: int, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, width: float = WIDTH):
        rng = np.random.default_rng(SEED)
        self.tables, self.blocks, self.probes = tables, blocks, probes
        self.project = rng.normal(size=(tables, dims, 8 * blocks)) / width
        self.shift = rng.uniform(0, 2, size=(tables, 8 * blocks))
        self.mix = rng.integers(1 << 62, size=(tables, 8 * blocks), dtype=np.int64) * 2 + 1

    def cells(self, u: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + probes): the number of the home cell and of the neighbouring ones, the nearest first.

        Cells that share a number by chance only meet more vectors.
        """
        out = np.empty((len(u), self.tables, 1 + self.probes), np.int64)
        for t in range(self.tables):
            y = u @ self.project[t] + self.shift[t]
            at, gain = np.empty_like(y), np.empty((len(u), 240 * self.blocks))
            for k in range(self.blocks):
                own = slice(8 * k, 8 * k + 8)
                at[:, own] = nearest(y[:, own])
                gain[:, 240 * k : 240 * k + 240] = (y[:, own] - at[:, own]) @ ROOTS.T
            mix = self.mix[t]
            steps = np.concatenate([(2 * ROOTS).astype(np.int64) @ mix[8 * k : 8 * k + 8] for k in range(self.blocks)])  # twice the lattice is whole
            with np.errstate(over="ignore"):
                home = (2 * at).astype(np.int64) @ mix + np.int64(t)
                best = np.argsort(-gain, axis=1, kind="stable")[:, : self.probes]
                out[:, t, 0], out[:, t, 1:] = home, home[:, None] + steps[best]
        return out


def first_meeting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of the first meeting of pairs by their cells: in each table a common home, then x's home that y is shown in, then y's home that x is shown in."""
    same = x[:, :, 0] == y[:, :, 0]
    shown_y = (x[:, :, :1] == y[:, :, 1:]).any(2)
    shown_x = (y[:, :, :1] == x[:, :, 1:]).any(2)
    return np.stack([same, shown_y, shown_x], 2).reshape(len(x), -1).argmax(1)


def _vectors(col: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Unit vectors, shorter ones filled up with zeros; by the largest entry first, so that no square runs over or under."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = np.diff(a.offsets.to_numpy())
    out = np.zeros((len(a), dims))
    out[np.arange(dims) < n[:, None]] = a.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _shown(lattice: Lattice, dims: int):
    """The cells alone, to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                yield pa.RecordBatch.from_arrays([pa.array(lattice.cells(_vectors(b.slice(at, 512)["vec"], dims)).ravel())], ["cell"])

    return run


def _entries(lattice: Lattice, dims: int):
    """A row for each cell that a vector is at home or shown in, with the vector as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                cells = lattice.cells(_vectors(part["vec"], dims))
                k, shown = len(cells), 1 + lattice.probes
                each = lattice.tables * shown
                row = pa.array(np.repeat(np.arange(k), each))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.ravel()), pa.array(np.tile(np.repeat(np.arange(lattice.tables, dtype=np.int32), shown), k)), pa.array(np.tile(np.arange(each) % shown == 0, k)), part["cid"].take(row), part["n"].take(row), part["vec"].take(row)], ["cell", "t", "home", "cid", "n", "vec"]
                )

    return run


class _Found:
    """Links of a block's members: partners counted, and a smallest member of each part."""

    def __init__(self, lattice: Lattice, least: float):
        self.lattice, self.least = lattice, least

    def links(self, cid, n, u, home, t, a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cid, links, part) for pairs of rows (a, b), b at home, that are near and meet here first."""
        cos = np.concatenate([np.einsum("ij,ij->i", u[a[i : i + 65_536]], u[b[i : i + 65_536]]) for i in range(0, len(a), 65_536)]) if len(a) else np.empty(0)
        near = cos >= self.least
        a, b = a[near], b[near]
        if not len(a):
            return (np.empty(0, np.int64),) * 3
        rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        cells = self.lattice.cells(u[rows])
        pa_, pb = place[: len(a)], place[len(a) :]
        first = np.empty(len(a), bool)
        for i in range(0, len(a), 65_536):
            own = slice(i, i + 65_536)
            swap = cid[a[own]] > cid[b[own]]
            x, y = np.where(swap, pb[own], pa_[own]), np.where(swap, pa_[own], pb[own])
            # b is at home in this cell: with a at home too, or the smaller of the two (x) or the larger (y) shown here
            kind = np.where(home[a[own]], 0, np.where(swap, 1, 2))
            first[own] = first_meeting(cells[x], cells[y]) == 3 * t[b[own]] + kind
        pa_, pb = pa_[first], pb[first]
        ids, mult = cid[rows], n[rows]
        total = np.bincount(pa_, mult[pb], len(rows)) + np.bincount(pb, mult[pa_], len(rows))
        part = np.arange(len(rows))
        while len(pa_):  # each takes the smallest of its part; rounds are as many as the longest way there
            low = np.minimum(part[pa_], part[pb])
            was = part.copy()
            np.minimum.at(part, pa_, low)
            np.minimum.at(part, pb, low)
            part = part[part]
            if (part == was).all():
                break
        some = total > 0
        return ids[some], total[some].astype(np.int64), ids[part[some]]


def _meet(lattice: Lattice, dims: int, least: float):
    """Entries come by block; one with all of a block's rows is compared, small ones together."""
    found, roughly = _Found(lattice, least), least - 1e-9

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {c: t[c].to_numpy() for c in ("cell", "bh", "ba", "t", "cid", "n")}
        home, as_home, as_any = (t[c].to_numpy() for c in ("home", "as_home", "as_any"))
        key = np.stack([cols["cell"], cols["bh"], cols["ba"]])
        starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
        ends = np.append(starts[1:], len(home))
        # a block without two rows, or with none at home, has nothing to say
        rows = [np.arange(s, e) for s, e in zip(starts, ends, strict=True) if e - s > 1 and as_home[s:e].any()]
        if not rows:
            return
        u = _vectors(t["vec"], dims)
        a, b, size = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            x = found.links(cols["cid"], cols["n"], u, home, cols["t"], np.concatenate(a), np.concatenate(b))
            if len(x[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["cid", "links", "part"])

        for r in rows:
            h, o = r[as_home[r]], r[as_any[r]]
            for at in range(0, len(o), max(1, AT_ONCE // len(h))):
                x = o[at : at + max(1, AT_ONCE // len(h))]
                if len(x) * len(h) > 4096:  # cosines of all by one product; only near ones go on
                    i, j = np.nonzero(u[x] @ u[h].T >= roughly)
                    x, y = x[i], h[j]
                else:
                    x, y = np.repeat(x, len(h)), np.tile(h, len(x))
                # two at home meet once, from the larger number
                ok = (cols["cid"][x] != cols["cid"][y]) & (~home[x] | (cols["cid"][x] > cols["cid"][y]))
                a.append(x[ok])
                b.append(y[ok])
                size += int(ok.sum())
                if size >= AT_ONCE:
                    yield from out()
                    a, b, size = [], [], 0
        if a:
            yield from out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows < ROWS:
                continue
            t = pa.concat_tables(held).combine_chunks()
            key = [t[c].to_numpy() for c in ("cell", "bh", "ba")]
            last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in key]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last block may go on
            if cut:
                yield from compare(t.slice(0, cut).combine_chunks())
            held, rows = [t.slice(cut)], t.num_rows - cut
        if rows:
            yield from compare(pa.concat_tables(held).combine_chunks())

    return run


def _links(classes: DataFrame, lattice: Lattice, dims: int, least: float) -> DataFrame:
    """(cid, links, part) of classes (cid, n, vec), from each block in which they have links."""
    entries = classes.mapInArrow(_entries(lattice, dims), f"cell long, t int, home boolean, cid long, n long, vec {classes.schema['vec'].dataType.simpleString()}")
    shown = classes.select("vec").mapInArrow(_shown(lattice, dims), "cell long")
    large = materialise(shown.groupBy("cell").agg(F.count("*").alias("m")).where(F.col("m") > CELL_ROWS), "large-cells")
    salted = large.select(F.col("cell").alias("__cell"), F.ceil(F.col("m") / CELL_ROWS).cast("int").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    x = entries.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int"))
    x = x.join(salted, (F.col("cell") == F.col("__cell")) & (F.col("salt") == F.col("__salt")), "left").withColumn("k", F.coalesce("k", F.lit(1)))
    x = x.withColumn("own", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("k")).cast("int"))
    # blocks (bh, ba): those at home in block bh against all of block ba
    each = F.sequence(F.lit(0), F.col("k") - 1)
    at = lambda h, o, as_h, as_a: F.struct(h.alias("bh"), o.alias("ba"), as_h.alias("as_home"), as_a.alias("as_any"))
    as_home = F.transform(each, lambda i: at(F.col("own"), i, F.lit(True), i == F.col("own")))
    as_any = F.transform(F.filter(each, lambda i: ~F.col("home") | (i != F.col("own"))), lambda i: at(i, F.col("own"), F.lit(False), F.lit(True)))
    where = F.when(F.col("home"), F.concat(as_home, as_any)).otherwise(as_any)
    x = x.select("cell", "t", "home", "cid", "n", "vec", F.explode(where).alias("b")).select("cell", "b.bh", "b.ba", "t", "home", "b.as_home", "b.as_any", "cid", "n", "vec")
    dealt = x.repartition("cell", "bh", "ba").sortWithinPartitions("cell", "bh", "ba")
    return dealt.mapInArrow(_meet(lattice, dims, least), "cid long, links long, part long")


def near_duplicates(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding", **params) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Rows are linked where the cosine of their vectors, in double precision, is `least` or more. n_links counts the other
    rows a row is linked with directly, component_id is the smallest vec_id it reaches, kept says whether that is its
    own. Vectors that are null, empty, all zero or hold null or non-finite entries are linked with nothing. Rows of one
    vec_id are rows of their own and only linked by their vectors; a row without an id is linked like any other, and
    has no component_id where none of its part has an id. Vectors of unequal length meet as if filled up with zeros.
    Equal vectors are linked with each other whatever rounding says. Every pair found is exact; at a cosine of 0.9 a
    pair of 64 entries shares a cell with probability 0.997, at 0.95 with 0.9999 (measured). An empty table gives no rows.

    params: tables, blocks, probes, width of the lattice. More blocks make cells smaller, for larger tables.
    """
    spark = vectors.sparkSession
    v = F.col(vector)
    fit = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    # signs of zeros do not make vectors differ
    whole = F.transform(v, lambda x: F.when(x == 0, F.lit(0)).otherwise(x).cast(vectors.schema[vector].dataType.elementType))
    rows = vectors.select(F.col(key).cast("long").alias(key), F.when(F.coalesce(fit, F.lit(False)), whole).alias("vec"))
    rows = rows.withColumns({"dir": F.sha2(F.array_join(F.transform("vec", lambda x: x.cast("string")), ","), 256), "salt": F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")})
    rows = rows.withColumn("dir", F.when(F.col("vec").isNotNull(), F.col("dir")))
    known = rows.where("vec is not null")
    # equal vectors by salts first: the rows of one vector go to SALTS tasks, and no more than SALTS rows to one after that
    salted = materialise(known.groupBy("dir", "salt").agg(F.min(key).alias("low"), F.count("*").alias("n"), F.first("vec").alias("vec")), "equal-vectors")
    classes = salted.groupBy("dir").agg(F.min("low").alias("low"), F.sum("n").alias("n"), F.first("vec").alias("vec"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    dims = classes.agg(F.max(F.size("vec"))).first()[0]
    rest = rows.where("vec is null").select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"))
    if not dims:
        return rest.withColumn("kept", F.lit(True))
    found = materialise(_links(classes.select("cid", "n", "vec"), Lattice(dims, **params), dims, least), "vector-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    of = components(found.where("cid <> part").select(F.col("cid").alias("a"), F.col("part").alias("b")).distinct())
    member = classes.select("cid", "dir", "low", "n").join(links, "cid", "left").join(of.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    member = materialise(member, "vector-members")
    # a part's smallest id, by salts
    low = member.groupBy("comp", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).alias("s")).agg(F.min("low").alias("low"))
    low = low.groupBy(F.col("comp").alias("c")).agg(F.min("low").alias("component_id"))
    done = member.join(low, F.col("comp") == F.col("c")).select(F.col("dir").alias("d"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    done = salted.select("dir", "salt").join(done, F.col("dir") == F.col("d")).select("d", F.col("salt").alias("s"), "n_links", "component_id")
    out = known.select(key, "dir", "salt").join(done, (F.col("dir") == F.col("d")) & (F.col("salt") == F.col("s"))).select(key, "n_links", "component_id")
    return out.unionByName(rest).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
