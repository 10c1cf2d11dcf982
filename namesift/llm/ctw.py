"""Language-model scores by context-tree weighting, beside unigram scores of words.

Bytes are coded as eight binary decisions. Each decision has a tree of contexts: none, the last byte, the last two
bytes and so on to `depth` bytes. Every node estimates by Krichevsky and Trofimov, and P_w = (P_kt + product of the
children's P_w) / 2 weighs all depths. The tree is gathered from all training texts and is then frozen: a text's
probability is the product of the tree's predictions. Up to depth two it is one table of 256**3 predictions; deeper
trees grow with the corpus and stay dealt out (deeptree.py).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesift.llm import blocks, deeptree
from namesift.llm.common import discard, id_remainder, materialise, partitions, release, small_batches

#: What ends each text in the model: as many of it as the depth before a text are the first context, one after it is coded.
END = 0
_GATHERED = "kind int, block long, part int, a binary, b binary"
_WORDS, _DOCS, _TREE = 0, 1, 2
#: Keys and texts are shuffled in so many groups, one after the other, and lie in kinds from these two on, for the disk's sake.
GROUPS, _KEY_GROUP, _TEXT_GROUP = 4, 16, 32
_NODES = np.array([[(1 << i) | (b >> (8 - i)) for i in range(8)] for b in range(256)])
_BITS = np.array([[(b >> (7 - i)) & 1 for i in range(8)] for b in range(256)])
_LGAMMA_HALF = math.lgamma(0.5)
#: Trees of at most this depth are one broadcast table.
TABLE = 2


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def _codes(raw: list[bytes], before: list[bytes] | None = None, last: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices (last byte, byte before it, byte) of all coded bytes of these texts, where each text's begin).

    Pieces of longer texts come with the two bytes before them, and only the last one of a text codes the end mark.
    """
    before, last = before or [b"\0\0"] * len(raw), last or [True] * len(raw)
    buf = np.frombuffer(b"".join(b + x + b"\0" * e for b, x, e in zip(before, raw, last, strict=True)), np.uint8)
    buf = blocks._LOWER[buf].astype(np.int32)
    lens = np.array([len(x) + 2 + e for x, e in zip(raw, last, strict=True)])
    starts = np.cumsum(lens) - lens
    at = np.ones(buf.size, bool)
    at[starts] = at[starts + 1] = False
    i = np.flatnonzero(at)
    return (buf[i - 1] << 16) | (buf[i - 2] << 8) | buf[i], starts - 2 * np.arange(len(raw))


def _cut(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(two bytes of context, part) of a text with its end mark."""
    raw = raw + bytes([END])
    for at in range(0, len(raw), blocks.BLOCK):
        yield (b"\0\0" + raw[max(0, at - 2) : at])[-2:], raw[at : at + blocks.BLOCK]


def _log10_sum(table: np.ndarray, raw: bytes) -> float:
    total = 0.0
    for before, part in _cut(raw):
        buf = blocks._LOWER[np.frombuffer(before + part, np.uint8)].astype(np.int32)
        total += float(table[(buf[1:-1] << 16) | (buf[:-2] << 8) | buf[2:]].sum(dtype=np.float64))
    return total


def _gather(parts: int, depth: int, key_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n_block, row = TaskContext.get().partitionId(), 0, 0
        tree = np.zeros(1 << 24 if depth <= TABLE else 0, np.int32)
        seen = False

        def texts():
            nonlocal row
            for b in batches:
                for doc_id, text, train, h in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    raw = (text or "").encode()
                    cut = list(blocks.pieces(raw))
                    at = 0
                    for i, x in enumerate(cut):
                        before = (bytes([END]) * depth + raw[max(0, at - depth) : at])[-depth:]
                        at += len(x)
                        yield (doc_id, (task << 32) | row, train, h, i == len(cut) - 1, before), x
                    row += 1

        for keys, raw in blocks.grouped(texts()):
            block = (task << 32) | n_block
            n_block += 1
            train = np.array([k[2] for k in keys])
            w = blocks.words(raw, True)
            order = np.argsort(w.hashes, kind="stable")
            h, d = w.hashes[order], w.text[order]
            new_word = np.diff(h, prepend=~h[:1]) != 0
            new_pair = new_word | (np.diff(d, prepend=-1) != 0)
            first_pair = np.flatnonzero(new_pair)
            count = np.diff(np.append(first_pair, h.size)).astype(np.uint32)
            pair_doc, pair_word = d[first_pair].astype(np.uint32), (np.cumsum(new_word) - 1)[first_pair]
            hashes = h[new_word]
            pairs_of = np.bincount(pair_word, minlength=hashes.size).astype(np.uint32)
            trained = np.bincount(pair_word, weights=count * train[pair_doc], minlength=hashes.size).astype(np.int64)
            part_of = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cut, pair_cut = np.searchsorted(part_of, np.arange(parts + 1)), np.searchsorted(part_of[pair_word], np.arange(parts + 1))
            out = []
            for p in np.flatnonzero(np.diff(cut)):
                x, y = slice(cut[p], cut[p + 1]), slice(pair_cut[p], pair_cut[p + 1])
                a = hashes[x].tobytes() + trained[x].tobytes()
                b = np.concatenate([pairs_of[x], pair_doc[y], count[y]]).astype(np.uint32)
                out.append((_WORDS, block, int(p), zlib.compress(a, 1), _pack(b.view(np.uint8).reshape(-1, 4).T)))
            n = np.bincount(w.text, minlength=len(raw))
            ids = [k[0] for k in keys]
            meta = np.array([[k[1] for k in keys], [k[3] for k in keys], n + [int(k[4]) for k in keys], [int(k[4]) for k in keys], train, [i is not None for i in ids], [i or 0 for i in ids]], np.int64)
            out.append((_DOCS, block, -1, meta.tobytes(), b""))
            if depth > TABLE:
                before, last = [k[5] for k in keys], [k[4] for k in keys]
                coded, lens = deeptree.keys_of(raw, before, last, depth)
                out += [(_KEY_GROUP + p % GROUPS, block, p, a, b) for p, a, b in deeptree.block_keys(coded, np.repeat(train, lens), key_parts, depth)]
                out.append((_TEXT_GROUP + (task + n_block - 1) % GROUPS, block, -1, *deeptree.pack_texts(keys, raw, before, last)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["kind", "block", "part", "a", "b"])
            # the tree's counts, from the training texts alone
            learn = [(x, k[5], k[4]) for x, k in zip(raw, keys, strict=True) if k[2] and depth <= TABLE]
            if learn:
                seen = True
                tree += np.bincount(_codes(*map(list, zip(*learn, strict=True)))[0], minlength=1 << 24).astype(np.int32)
        if seen:
            by = tree.reshape(256, 65536)
            out = []
            for c in np.flatnonzero(by.any(1)):
                at = np.flatnonzero(by[c])
                out.append((_TREE, task, int(c), _pack(at.astype(np.uint16)), _pack(by[c, at].astype(np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["kind", "block", "part", "a", "b"])

    return run


def _merge_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each block's words of this part with their count over all blocks; a row of block -1 has the part's totals."""
    hashes, trained = [], []
    for a in pdf["a"]:
        raw = zlib.decompress(a)
        n = len(raw) // 16
        hashes.append(np.frombuffer(raw, np.uint64, n))
        trained.append(np.frombuffer(raw, np.int64, n, 8 * n))
    words, back = np.unique(np.concatenate(hashes), return_inverse=True)
    c = np.bincount(back, weights=np.concatenate(trained), minlength=words.size).astype(np.int64)
    at = np.cumsum([0, *map(len, hashes)])
    own = [_pack(c[back[at[i] : at[i + 1]]]) for i in range(len(hashes))]
    return pd.DataFrame({"block": [*pdf["block"], -1], "part": [*pdf["part"], pdf["part"].iloc[0]], "c": [*own, np.array([c.sum(), (c > 0).sum()]).tobytes()]})


def _score_block(n_all: int, v_all: int, ends_all: int):
    low = math.log10(n_all + v_all + 1)

    def run(mine: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        row, text_hash, n_tokens, ends, train, named, ids = np.frombuffer(mine.loc[mine["part"] == -1, "a"].iloc[0], np.int64).reshape(7, -1)
        total, known = np.zeros(row.size), np.zeros(row.size, np.int64)
        by = dict(zip(counts["part"], counts["c"], strict=True))
        for part, b in zip(mine["part"], mine["b"], strict=True):
            if part < 0:
                continue
            c = _unpack(by[part], np.int64)
            flat = np.ascontiguousarray(_unpack(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
            n = c.size
            pairs = (flat.size - n) // 2
            c = np.repeat(c, flat[:n])
            doc, count = flat[n : n + pairs], flat[n + pairs :]
            total += np.bincount(doc, weights=count * (np.log10(c + 1.0) - low), minlength=row.size)
            known += np.bincount(doc, weights=count * (c > 0), minlength=row.size).astype(np.int64)
        total += ends * (math.log10(ends_all + 1.0) - low)
        known += ends * (ends_all > 0)
        doc_id = pd.array(ids, "Int64")
        doc_id[named == 0] = pd.NA
        return pd.DataFrame({"row": row, "doc_id": doc_id, "hash": text_hash, "train": train.astype(bool), "n_tokens": n_tokens, "n_known": known, "base_score": total})

    return run


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - 2 * _LGAMMA_HALF - _lgamma(n0 + n1 + 1.0)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma by Stirling's series after raising the argument by eight."""
    y = x + 8
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    low = np.ones_like(x)
    for i in range(8):
        low = low * (x + i)
    return out - np.log(low)


def _bit_counts(byte_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) at the 256 nodes of the binary tree over a byte, from counts [..., 256]."""
    levels = [byte_counts]
    while levels[-1].shape[-1] > 1:
        levels.append(levels[-1].reshape(*byte_counts.shape[:-1], -1, 2).sum(-1))
    zeros, ones = np.zeros(byte_counts.shape), np.zeros(byte_counts.shape)
    for i in range(8):
        x = levels[7 - i]
        zeros[..., 1 << i : 2 << i], ones[..., 1 << i : 2 << i] = x[..., ::2], x[..., 1::2]
    return zeros, ones


def _mixed(log_kt: np.ndarray, log_children: np.ndarray, ones: np.ndarray, zeros: np.ndarray, below: np.ndarray) -> np.ndarray:
    """P(next bit is 1) of a node, weighing its own estimate against that of the context below it; P(next bit is 0) with ones and zeros in each other's place."""
    own = 1 / (1 + np.exp(np.clip(log_children - log_kt, -700, 700)))
    return own * (ones + 0.5) / (ones + zeros + 1) + (1 - own) * below


def _subtree(pdf: pd.DataFrame) -> pd.DataFrame:
    """Depths two and one under one last byte: the mixed predictions as log odds, which hold both bits' however small, and what depth none needs."""
    counts = np.zeros(65536, np.int64)
    for a, b in zip(pdf["a"], pdf["b"], strict=True):
        counts[_unpack(a, np.uint16)] += _unpack(b, np.int64)
    z2, o2 = _bit_counts(counts.reshape(256, 256).astype(float))
    z1, o1 = z2.sum(0), o2.sum(0)
    children, kt = _kt(z2, o2).sum(0), _kt(z1, o1)
    one, zero = (_mixed(kt, children, n1, z1 + o1 - n1, (n2 + 0.5) / (o2 + z2 + 1)) for n1, n2 in ((o1, o2), (z1, z2)))
    weighted = np.logaddexp(kt, children) - math.log(2)
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "p": [_pack(np.log(one / zero).astype(np.float32))], "w": [np.stack([weighted, z1, o1]).tobytes()]})


def predictions(subtrees: list) -> np.ndarray:
    """log10 P(byte | last byte, byte before it) for all 2**24 triples, from the at most 256 subtrees."""
    weighted, z, o = np.zeros(256), np.zeros(256), np.zeros(256)
    for r in subtrees:
        w = np.frombuffer(r["w"], float).reshape(3, 256)
        weighted, z, o = weighted + w[0], z + w[1], o + w[2]
    kt = _kt(z, o)
    table = np.empty((256, 256, 256), np.float32)
    even = np.zeros((256, 256))
    by = {r["part"]: r["p"] for r in subtrees}
    last = None
    for c in range(256):
        if c not in by and last is not None:
            table[c] = table[last]
            continue
        odds = _unpack(by[c], np.float32).reshape(256, 256).astype(float) if c in by else even
        logs = np.log10(np.stack([_mixed(kt, weighted, z, o, 1 / (1 + np.exp(odds))), _mixed(kt, weighted, o, z, 1 / (1 + np.exp(-odds)))]))
        table[c] = sum(logs[_BITS[:, i], :, _NODES[:, i]].T for i in range(8))
        if c not in by:
            last = c
    return table.ravel()


def _results(n_all: int) -> list[Column]:
    bits = -F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)
    return [(~F.col("train")).alias("held_out"), F.col("n_tokens"), F.col("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), F.col("base_score"), F.col("score"), F.col("n_bytes"), bits.alias("bits_per_byte")]


def _deep(gathered: DataFrame, parts: int, depth: int) -> DataFrame:
    """(row, score, n_bytes) of all texts, from the counts of contexts of up to `depth` bytes."""
    spark = gathered.sparkSession
    kinds = range(_KEY_GROUP, _KEY_GROUP + GROUPS)

    def each_part(kind: int, run, schema: str) -> DataFrame:
        return gathered.where(f"kind = {kind}").select("block", "part", "a", "b").groupBy("part").applyInPandas(run, schema)

    def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        out = materialise(df, name, by)
        release(spark)
        return out

    def all_of(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, tables)

    tops = [written(each_part(k, deeptree.part_top(depth), "last int, a binary, b binary"), "ctw-top") for k in kinds]
    rows = all_of(tops).groupBy("last").applyInPandas(deeptree.last_byte, "last int, second binary, p binary, w binary").collect()
    model = spark.sparkContext.broadcast(deeptree.upper(rows))
    del rows
    # the group of a block's texts
    own = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(GROUPS)).cast("int").alias("own")
    lengths = []
    for top, k in zip(tops, kinds, strict=True):
        discard(top)
        lengths.append(written(each_part(k, deeptree.part_scores(depth, model), "block long, part int, s binary").select("block", "part", "s", own), "ctw-code-lengths", "own"))
        discard(gathered, f"kind={k}")
    pieces = []
    for g in range(GROUPS):
        texts = gathered.where(f"kind = {_TEXT_GROUP + g}").select("block", "a", "b")
        scores = all_of([x.where(f"own = {g}").select("block", "part", "s") for x in lengths])
        pieces.append(written(texts.groupBy("block").cogroup(scores.groupBy("block")).applyInPandas(deeptree.block_scores(parts, depth), "row long, score double, n_bytes long"), "ctw-pieces"))
        for x in lengths:
            discard(x, f"own={g}")
        discard(gathered, f"kind={_TEXT_GROUP + g}")
    out = written(all_of(pieces).groupBy("row").agg(F.sum("score").alias("score"), F.sum("n_bytes").alias("n_bytes")), "ctw-deep")
    for x in pieces + lengths:
        discard(x)
    return out


def score(docs: DataFrame, modulus: int = 7, held_out: int = 2, depth: int = TABLE) -> DataFrame:
    """Code lengths and unigram scores of whole texts.

    Learns from the documents whose crc32(doc_id as text) mod `modulus` is not `held_out`. A to Z count as lower
    case. Tokens are the words and one end for each text; the model codes the UTF-8 bytes and an end mark.
    Null and empty texts have the end alone. Repeated rows each count and each give a row; a null doc_id counts as
    the empty text where the remainder is taken. Without training documents the tree predicts evenly. The longest
    contexts have `depth` bytes: 2, or 3 to 7.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.
    """
    if not TABLE <= depth <= deeptree.MOST:
        raise ValueError(f"depth must be from {TABLE} to {deeptree.MOST}")
    spark = docs.sparkSession
    small_batches(spark)
    key_parts = max(64, partitions(spark))
    if depth > TABLE:
        key_parts = max(key_parts, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // deeptree.PART_BYTES)
    out_of = id_remainder("doc_id", modulus) == held_out
    given = docs.select("doc_id", "text", (~out_of).alias("train"), F.xxhash64("text").alias("hash"))
    gathered = materialise(given.mapInArrow(_gather(max(64, partitions(spark)), depth, key_parts), _GATHERED), "ctw-gathered", "kind")
    words = gathered.where(f"kind = {_WORDS}")
    counts = materialise(words.select("block", "part", "a").groupBy("part").applyInPandas(_merge_words, "block long, part int, c binary"), "ctw-counts")
    totals = np.sum([np.frombuffer(r["c"], np.int64) for r in counts.where("block = -1").select("c").collect()] or [np.zeros(2, np.int64)], axis=0)
    trained_docs = docs.where(~out_of).count()
    n_all, v_all = int(totals[0]) + trained_docs, int(totals[1]) + bool(trained_docs)
    base = (
        gathered.where(f"kind in ({_WORDS}, {_DOCS})").select("block", "part", F.expr(f"if(kind = {_DOCS}, a, null)").alias("a"), "b").groupBy("block")
        .cogroup(counts.where("block >= 0").groupBy("block"))
        .applyInPandas(_score_block(n_all, v_all, trained_docs), "row long, doc_id long, hash long, train boolean, n_tokens long, n_known long, base_score double")
    )
    base = base.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("hash").alias("hash"), F.first("train").alias("train"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score")))
    if depth > TABLE:
        base = materialise(base, "ctw-words")
        discard(counts)
        for kind in (_WORDS, _DOCS):
            discard(gathered, f"kind={kind}")
        release(spark)
        deep = _deep(gathered, key_parts, depth)
        discard(gathered)
        return base.join(deep, "row").select("doc_id", *_results(n_all))
    subtrees = gathered.where(f"kind = {_TREE}").select("part", "a", "b").groupBy("part").applyInPandas(_subtree, "part int, p binary, w binary").collect()
    table = spark.sparkContext.broadcast(predictions(subtrees))
    base = materialise(base, "ctw-base")
    discard(gathered)
    discard(counts)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            if sum(map(len, raw)) <= blocks.BLOCK and raw:
                codes, starts = _codes(raw)
                s = np.add.reduceat(table.value[codes].astype(np.float64), starts)
            else:
                s = np.array([_log10_sum(table.value, x) for x in raw])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array([len(x) for x in raw], pa.int64())], ["doc_id", "hash", "score", "n_bytes"])

    model = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(scored, "doc_id long, hash long, score double, n_bytes long").dropDuplicates(["doc_id", "hash"])
    b, m = base.alias("b"), model.alias("m")
    return b.join(m, F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("b.hash").eqNullSafe(F.col("m.hash"))).select("b.doc_id", *_results(n_all))
