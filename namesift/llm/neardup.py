"""Near-duplicate documents: MinHash with tensored banding, verified on full shingle sets.

Two collections of SIDE keys, each of WIDTH minhashes, stand for SIDE * SIDE tables: table (i, j) is keyed by key i
of the first and key j of the second. Rows meet by the first key alone; pairs of keys are formed where they lie, so
2 * SIDE * WIDTH minhashes do the work of SIDE**2 * 2 * WIDTH. Equal sets are one before that. In each bucket only
links to one member, the most central, are emitted and verified on full sets, and each verified member keeps the
shingles that it and the leader do not share. Two members differ by those that only one of them has in these, so
members of different components that met the same leader are compared without their texts, in blocks of bounded size,
and only links between them leave the block: no link between different texts of a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesift.llm import blocks
from namesift.llm.common import discard, materialise, release, small_batches
from namesift.operators.align import row_numbers

SIDE, WIDTH = 16, 3
#: Rows that meet in one go.
GROUP_ROWS = 65_536
#: Rows of a block in which members around one leader are compared: those of other components, and all.
STRAY_ROWS, MEMBER_ROWS = 128, 1024
#: Distinct shingles of a block counted in one go.
COLUMNS = 4096
#: Ids of documents whose texts are fetched by a broadcast of the ids; more are fetched by a shuffle.
BROADCAST_IDS = 200_000
_RNG = np.random.default_rng(20240607)
_MUL = _RNG.integers(0, 1 << 63, 2 * SIDE * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, 2 * SIDE * WIDTH, dtype=np.uint64)


def shingle_sets(raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, by text: `width` consecutive words, or all words of a text with fewer."""
    w = blocks.words(raw, True)
    n = w.hashes.size
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    first, last = np.searchsorted(w.text, w.text), np.searchsorted(w.text, w.text, side="right")
    left = last - np.arange(n)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            inside = np.flatnonzero(left > i)
            h[inside] = (h[inside] + w.hashes[inside + i]) * np.uint64(0x9FB21C651E98DF25)
    whole = (left >= width) | (np.arange(n) == first)
    text, h = w.text[whole], blocks.mix(h[whole])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]))
    return text[new], h[new]


def signatures(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each of n texts: (set size, two 64-bit digests of the set, SIDE first keys, SIDE second keys)."""
    size = np.bincount(text, minlength=n)
    some = np.flatnonzero(size)
    digest, first, second = np.zeros((n, 2), np.uint64), np.zeros((n, SIDE), np.uint64), np.zeros((n, SIDE), np.uint64)
    if some.size:
        starts = (np.cumsum(size) - size)[some]
        with np.errstate(over="ignore"):
            digest[some, 0], digest[some, 1] = np.add.reduceat(blocks.mix(h), starts), np.add.reduceat(blocks.mix(~h), starts)
            for k in range(2 * SIDE):
                key = np.full(some.size, k, np.uint64)
                for f in range(k * WIDTH, (k + 1) * WIDTH):
                    key = blocks.mix(key ^ np.minimum.reduceat(h * _MUL[f] + _ADD[f], starts))
                (first if k < SIDE else second)[some, k % SIDE] = key
    return size, digest, first, second


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for key, t in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2).to_pylist(), strict=True):
                    yield key, (t or "").encode()

        for keys, raw in blocks.grouped(rows()):
            n, digest, first, second = signatures(*shingle_sets(raw, width), len(raw))
            cols = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(n, pa.int64()), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)),
                    pa.array([x.tobytes() for x in first], pa.binary()), pa.array([x.tobytes() for x in (second >> np.uint64(32)).astype(np.uint32)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "n", "s1", "s2", "first", "second"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each first key of a set."""
    for b in batches:
        first = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64)
        key = blocks.mix(first + np.tile(np.arange(SIDE, dtype=np.uint64), b.num_rows)).view(np.int64)
        at = pa.array(np.repeat(np.arange(b.num_rows), SIDE))
        yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(at), b.column(1).take(at), b.column(3).take(at)], ["key", "id", "n", "second"])


def _meet():
    """(a, b): a bucket's most central member with each other member of it.

    Rows come sorted by key. Central is who shares most of the second keys with the others under its first key, of
    equals the smallest id. Groups of one first key are taken whole; of one with more than GROUP_ROWS members the
    leaders so far lead on in the parts after.
    """

    def pairs(key, ids, n, second, leads) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, rows that lead)."""
        bucket = blocks.mix(key.view(np.uint64)[:, None] ^ blocks.mix((second.astype(np.uint64) << np.uint64(8)) | np.arange(SIDE, dtype=np.uint64))).ravel()
        row = np.repeat(np.arange(len(ids)), SIDE)
        order = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
        lens = np.diff(np.append(starts, bucket.size))
        central = np.bincount(row[order], weights=np.repeat(lens, lens))
        place = np.empty(len(ids), np.int64)
        place[np.lexsort((ids, -central, ~leads))] = np.arange(len(ids))
        order = order[np.lexsort((place[row[order]], np.repeat(np.arange(lens.size), lens)))]
        many = lens > 1
        first = np.repeat(row[order[starts[many]]], lens[many] - 1)
        inside = np.repeat(many, lens)
        inside[starts] = False
        other = row[order[inside]]
        fits = ids[first] != ids[other]
        return np.unique(np.column_stack([ids[first[fits]], ids[other[fits]]]), axis=0), np.unique(row[order[starts]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, SIDE), np.uint32))
        carry = empty

        def out(found):
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))], ["a", "b"])

        def flush(last: bool):
            nonlocal held, rows, carry
            part = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            key = part[0]
            whole = key.size if last else np.searchsorted(key, key[-1])  # rows of the last key may go on
            if carry[0].size and (whole == 0 or key[0] != carry[0][0]) and key[0] != carry[0][0]:
                carry = empty
            if whole == 0 and key.size < GROUP_ROWS:
                held, rows = [part], key.size
                return
            end = whole or key.size
            now = tuple(np.concatenate([c, x[:end]]) for c, x in zip(carry, part, strict=True))
            leads = np.arange(now[0].size) < carry[0].size
            same = now[0][1:] == now[0][:-1]
            shared = np.append(False, same) | np.append(same, False)
            carry = empty
            if shared.any():
                now = tuple(x[shared] for x in now)
                found, lead = pairs(*now, leads[shared])
                yield from out(found)
                if not whole:
                    carry = tuple(x[lead] for x in now)
            rest = tuple(x[end:] for x in part)
            held, rows = ([rest], rest[0].size) if rest[0].size else ([], 0)

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint32).reshape(-1, SIDE)))
                rows += b.num_rows
                if rows >= GROUP_ROWS:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


def _verify(width: int, percent: int):
    """(a, b, ok, n, apart): whether they are linked, the number of b's shingles, and the shingles that one of them alone has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [[t.encode() for t in batch.column(i).to_pylist()] for i in (2, 3)]
            total, at = batch.num_rows, 0
            ok, nb, apart = np.zeros(total, bool), np.zeros(total, np.int64), []
            while at < total:
                end, size = at, 0
                while end < total and (end == at or size < blocks.BLOCK):
                    size += len(texts[0][end]) + len(texts[1][end])
                    end += 1
                k = end - at
                text, h = shingle_sets(texts[0][at:end] + texts[1][at:end], width)
                n = np.bincount(text, minlength=2 * k)
                pair = text % k
                order = np.lexsort((h, pair))
                h, pair = h[order], pair[order]
                twice = np.append((h[1:] == h[:-1]) & (pair[1:] == pair[:-1]), False)
                both = np.bincount(pair[twice], minlength=k)
                ok[at:end], nb[at:end] = 100 * both >= percent * (n[:k] + n[k:] - both), n[k:]
                alone = ~twice & ~np.append(False, twice[:-1])[: twice.size]
                own = h[alone]
                ends = np.searchsorted(pair[alone], np.arange(k + 1))
                apart += [own[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok), pa.array(nb), pa.array(apart, pa.binary())], ["a", "b", "ok", "n", "apart"])

    return run


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Common elements of each of x with each of y, sets of numbers, by products of columns of incidences."""
    out = np.zeros((len(x), len(y)), np.float32)
    flat_x, flat_y = np.concatenate(x), np.concatenate(y)
    of_x, of_y = np.repeat(np.arange(len(x)), [e.size for e in x]), np.repeat(np.arange(len(y)), [e.size for e in y])
    common = np.intersect1d(flat_x, flat_y)
    for at in range(0, common.size, COLUMNS):
        part = common[at : at + COLUMNS]
        sides = []
        for flat, of, n in ((flat_x, of_x, len(x)), (flat_y, of_y, len(y))):
            col = np.minimum(np.searchsorted(part, flat), part.size - 1)
            here = part[col] == flat
            m = np.zeros((n, part.size), np.float32)
            m[of[here], col[here]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _links_in_block(percent: int):
    """Links between the strays of a block and its members of other components, from what each does not share with the leader."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, s = pdf[pdf["is_y"]], pdf[~pdf["is_y"]]
        found = [np.empty((0, 2), np.int64)]
        if len(y) and len(s):
            # hashing may give a block more rows than meant, so it is cut again
            for i in range(0, len(y), STRAY_ROWS):
                u = y.iloc[i : i + STRAY_ROWS]
                ud = [np.frombuffer(e, np.uint64) for e in u["apart"]]
                for j in range(0, len(s), MEMBER_ROWS):
                    v = s.iloc[j : j + MEMBER_ROWS]
                    vd = [np.frombuffer(e, np.uint64) for e in v["apart"]]
                    sizes = u["n"].to_numpy()[:, None] + v["n"].to_numpy()[None, :]
                    differ = np.array([e.size for e in ud])[:, None] + np.array([e.size for e in vd])[None, :] - 2 * _overlaps(ud, vd).astype(np.int64)
                    both = (sizes - differ) // 2
                    ok = (100 * both >= percent * (sizes - both)) & (u["c"].to_numpy()[:, None] != v["c"].to_numpy()[None, :])
                    p, q = np.nonzero(ok)
                    found.append(np.sort(np.column_stack([u["b"].to_numpy()[p], v["b"].to_numpy()[q]]), 1))
        out = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    return run


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in links (a, b): comp is the smallest id it is connected with.

    Each round points every node to its smallest neighbour or itself and contracts; pointers are followed at the end.
    Rounds grow with the logarithm of the longest chain.
    """
    pointers, edges = [], links.where("a <> b")
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("to")), "pointers")
        pointers.append(to)
        x = edges.join(to.select(F.col("id").alias("a"), F.col("to").alias("a_to")), "a").join(to.select(F.col("id").alias("b"), F.col("to").alias("b_to")), "b")
        edges = materialise(x.where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            break
    out = pointers[0].select("id", F.col("to").alias("comp"))
    for to in pointers[1:]:
        out = out.join(to.select(F.col("id").alias("comp"), "to"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    return out


class _Search:
    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs, width, percent
        self.spark = docs.sparkSession
        small_batches(self.spark)
        given = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
        self.signed = materialise(given.mapInArrow(_sign(width), "doc_id long, th long, n long, s1 long, s2 long, first binary, second binary"), "signatures")
        alike = self.signed.where("n > 0 and doc_id is not null").groupBy("s1", "s2")
        self.sets = materialise(alike.agg(F.min("doc_id").alias("id"), F.min_by("th", "doc_id").alias("th"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("second").alias("second")), "sets")

    def candidates(self) -> DataFrame:
        rows = self.sets.select("id", "n", "first", "second").mapInArrow(_bands, "key long, id long, n long, second binary")
        dealt = rows.repartition("key").sortWithinPartitions("key", "id")
        return dealt.mapInArrow(_meet(), "a long, b long").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        need = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct().join(self.sets.select("id", "th"), "id")
        need = materialise(need.withColumnRenamed("id", "need_id").withColumnRenamed("th", "need_th"), "needed")
        need = F.broadcast(need) if need.count() <= BROADCAST_IDS else need.hint("shuffle_hash")
        same = (F.col("doc_id").cast("long") == F.col("need_id")) & (F.xxhash64("text") == F.col("need_th"))
        texts = materialise(self.docs.select("doc_id", "text").join(need, same).select(F.col("need_id").alias("id"), "text").dropDuplicates(["id"]), "texts")
        a, b = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text")), texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))
        out = materialise(pairs.join(a, "a").join(b, "b").select("a", "b", "a_text", "b_text").mapInArrow(_verify(self.width, self.percent), "a long, b long, ok boolean, n long, apart binary"), "verified")
        discard(texts)
        return out

    def apart(self, tested: DataFrame, comps: DataFrame) -> DataFrame:
        """Links (a, b) around one leader between members that are not in one component yet.

        Only leaders with members of other components are looked at. Their strays meet all members in blocks, dealt
        out by hashes of the ids, so that no task has a whole group; a block gives only links.
        """
        of = lambda c: comps.select(F.col("id").alias(c), F.col("comp").alias(f"{c}_comp"))
        x = tested.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({"a_comp": F.coalesce("a_comp", "a"), "b_comp": F.coalesce("b_comp", "b")})
        x = x.select("a", "b", "n", "apart", F.col("b_comp").alias("c"), (F.col("a_comp") != F.col("b_comp")).alias("stray"))
        x = materialise(x.where("stray").select("a").distinct().join(x, "a"), "around")
        cuts = lambda n, most: F.ceil(n / most).cast("int")
        sizes = x.groupBy("a").agg(F.sum(F.col("stray").cast("int")).alias("strays"), F.count("*").alias("members")).where("members > 1")
        sizes = sizes.select("a", cuts(F.col("strays"), STRAY_ROWS).alias("ys"), cuts(F.col("members"), MEMBER_ROWS).alias("ss"))
        rows = x.join(sizes, "a").select("*", F.pmod(F.xxhash64("b"), F.col("ys")).cast("int").alias("i"), F.pmod(F.xxhash64("b", F.lit(1)), F.col("ss")).cast("int").alias("j"))
        y = rows.where("stray").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ss") - 1)))
        s = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ys") - 1)))
        block = ["a", "i", "j", "b", "n", "c", "apart"]
        dealt = y.select(*block, F.lit(True).alias("is_y")).unionByName(s.select(*block, F.lit(False).alias("is_y")))
        return dealt.groupBy("a", "i", "j").applyInPandas(_links_in_block(self.percent), "a long, b long").distinct()

    def run(self) -> DataFrame:
        """(id, comp) of the sets that have a link."""
        pairs = materialise(self.candidates(), "pairs")
        release(self.spark)
        tested = self.verified(pairs)
        discard(pairs)
        links = tested.where("ok").select("a", "b")
        comps = materialise(components(links), "components")
        rest = materialise(self.apart(tested, comps), "pairs")
        release(self.spark)
        if rest.isEmpty():
            return comps
        more = self.verified(rest).where("ok").select("a", "b")
        if more.isEmpty():
            return comps
        return materialise(components(links.unionByName(more)), "components")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Documents are linked where 100 * shared >= percent * all distinct shingles of `width` words (A to Z as lower
    case). component_id is the smallest doc_id reachable, kept says whether it is the row's own. Texts without words
    (null, empty) and rows without an id are linked with nothing; repeated rows are copies like any other. A link of
    Jaccard 0.8 shares a bucket with probability 0.99998, any closer one with more; all links are verified.
    """
    s = _Search(docs, width, percent)
    comps = s.run()
    by_set = s.sets.select("s1", "s2", "id").join(comps, "id", "left").select("s1", "s2", F.coalesce("comp", "id").alias("component_id"))
    some = s.signed.where("n > 0 and doc_id is not null").select("doc_id", "n", "s1", "s2").join(by_set, ["s1", "s2"])
    rows = some.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = s.signed.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    # a text without words under an id that other rows have too is its own component all the same
    return rows.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with the first document of each group of near-duplicates alone, once; the columns of docs. Rows without an id stay.

    Rows that share an id and the text are one document, those that share an id alone are several.
    """
    named, th = docs.where("doc_id is not null"), F.xxhash64("text")
    per_id = named.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct(th).alias("texts")).agg(F.max("n"), F.max("texts")).first()
    if (per_id[1] or 0) > 1:
        # the search knows documents by id, so they are numbered in the order of their ids
        every = named.select(F.col("doc_id").cast("long").alias("__id"), th.alias("__th")).distinct()
        numbers = materialise(row_numbers(every, "__id", "__no"), "document-numbers")
        same = (F.col("doc_id").cast("long") == F.col("__id")) & (th == F.col("__th"))
        numbered = materialise(named.select("doc_id", "text").join(numbers, same).select(F.col("__no").cast("long").alias("doc_id"), "text"), "numbered-documents")
        gone = near_duplicates(numbered, width, percent).where("not kept").select(F.col("doc_id").alias("__no")).distinct()
        gone = numbers.join(gone, "__no", "left_semi").select(F.col("__id").alias("__gone_id"), F.col("__th").alias("__gone_th"))
        left = docs.join(gone.hint("shuffle_hash"), (F.col("doc_id").cast("long") == F.col("__gone_id")) & (th == F.col("__gone_th")), "left_anti")
        once = left.where("doc_id is not null").withColumn("__th", th).dropDuplicates(["doc_id", "__th"]).drop("__th")
        return once.unionByName(left.where("doc_id is null"))
    gone = near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias("__gone_id")).distinct()
    left = docs.join(gone.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("__gone_id"), "left_anti")
    if (per_id[0] or 0) <= 1:
        return left
    return left.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(left.where("doc_id is null"))
