"""Context-tree weighting with contexts of three and more bytes, gathered as counts that grow with the corpus.

A key is (last byte, the byte before it, ..., the coded byte) as one number. Each block of texts has its distinct keys
with their counts in training texts, dealt to parts by a hash of the last three bytes of context. A part has all keys
under its contexts, so it weighs the depths from three on by itself. Depths two, one and none are weighed in at most
256 groups from what the parts hand up, and come to each prediction as p = a + b * (prediction of depth three), where
a and b depend on the last two bytes alone. A zero has an a of its own: one less p is nothing, or below it, where counts
reach some ten millions. Each block gets back one code length for each of its keys.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd

from namesift.llm import blocks

#: Context bytes that a 64-bit key has room for.
MOST = 7
#: Bytes of input for each part, so that a part stays small however large the corpus.
PART_BYTES = 2 << 20
_SMALL = 128
_LN2 = math.log(2)


def keys_of(raw: list[bytes], before: list[bytes], last: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all coded bytes, number of them in each text); before has `depth` bytes of context, an end is coded where last."""
    parts = [b + x + (b"\0" if e else b"") for x, b, e in zip(raw, before, last, strict=True)]
    buf = blocks._LOWER[np.frombuffer(b"".join(parts), np.uint8)]
    lens = np.array([len(x) for x in parts])
    starts = np.cumsum(lens) - lens
    at = np.ones(buf.size, bool)
    for i in range(depth):
        at[starts + i] = False
    at = np.flatnonzero(at)
    key = buf[at].astype(np.uint64)
    for i in range(1, depth + 1):
        key |= buf[at - i].astype(np.uint64) << np.uint64(8 * (depth + 1 - i))
    return key, lens - depth


def part_of(keys: np.ndarray, parts: int, depth: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = blocks.mix((keys >> np.uint64(8 * (depth - 2))) + np.uint64(1))
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def pack(x: np.ndarray) -> bytes:
    """Numbers with their byte planes apart, which compress better."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def unpack(x: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def block_keys(keys: np.ndarray, trained: np.ndarray, parts: int, depth: int) -> list[tuple[int, bytes, bytes]]:
    """(part, distinct keys, their counts in training texts) of one block."""
    both = np.sort((keys << np.uint64(1)) | trained.astype(np.uint64)) if depth < MOST else None
    if both is None:
        order = np.argsort(keys, kind="stable")
        k, t = keys[order], trained[order].astype(np.int64)
    else:
        k, t = both >> np.uint64(1), (both & np.uint64(1)).astype(np.int64)
    first = np.flatnonzero(np.diff(k, prepend=~k[:1]) != 0)
    k, n = k[first], np.add.reduceat(t, first)
    part = part_of(k, parts, depth)
    order = np.argsort(part, kind="stable")
    k, n = k[order], n[order]
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    return [(int(p), pack(k[x]), pack(n[x].astype(np.uint32))) for p in np.flatnonzero(np.diff(cut)) for x in [slice(cut[p], cut[p + 1])]]


class _Kt:
    """log Krichevsky-Trofimov probabilities; small counts from a table."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, z: np.ndarray, o: np.ndarray) -> np.ndarray:
        from namesift.llm.ctw import _kt

        if cls.table is None:
            i = np.arange(_SMALL, dtype=float)
            cls.table = _kt(i[:, None], i[None, :])
        out = cls.table[np.minimum(z, _SMALL - 1), np.minimum(o, _SMALL - 1)]
        big = np.flatnonzero((z >= _SMALL) | (o >= _SMALL))
        if big.size:
            out[big] = _kt(z[big].astype(float), o[big].astype(float))
        return out


class Part(NamedTuple):
    """Distinct keys of a part, the predictions of depth three for the bits of each, and what depth two needs."""

    keys: np.ndarray
    #: P(bit i is 1) by the depths from three on, for each of the eight bits.
    ones: list[np.ndarray]
    #: Of each bit: (last three bytes and node) of the nodes of depth three, zeros, ones, log weighted probability.
    top: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def weigh(keys: np.ndarray, counts: np.ndarray, depth: int) -> Part:
    """All depths from `depth` up to three. Keys without training count have no effect; they are predicted alike."""
    uniq, n_of, up = {depth: keys}, {depth: counts}, {}
    for d in range(depth - 1, 2, -1):
        k = uniq[d + 1]
        shorter = ((k >> np.uint64(16)) << np.uint64(8)) | (k & np.uint64(255))
        uniq[d], up[d] = np.unique(shorter, return_inverse=True)
        n_of[d] = np.bincount(up[d], weights=n_of[d + 1], minlength=uniq[d].size).astype(np.int64)
    ones, top = [], []
    for i in range(8):
        own, pred, group, first, log_w = {}, {}, {}, {}, None
        for d in range(depth, 2, -1):
            node = uniq[d] >> np.uint64(8 - i)
            edge = np.diff(node, prepend=~node[:1]) != 0
            first[d] = np.flatnonzero(edge)
            group[d] = np.cumsum(edge) - 1
            n = np.add.reduceat(n_of[d], first[d])
            o = np.add.reduceat(n_of[d] * ((uniq[d] >> np.uint64(7 - i)) & np.uint64(1)).astype(np.int64), first[d])
            kt = _Kt.of(n - o, o)
            pred[d] = (o + 0.5) / (n + 1)
            if d == depth:
                log_w = kt
            else:
                children = np.bincount(group[d][up[d][first[d + 1]]], weights=log_w, minlength=n.size)
                own[d] = 1 / (1 + np.exp(np.clip(children - kt, -700, 700)))
                log_w = np.logaddexp(kt, children) - _LN2
        p, at = pred[depth], first[depth]
        for d in range(depth - 1, 2, -1):
            at = up[d][at]
            g = group[d][at]
            p = own[d][g] * pred[d][g] + (1 - own[d][g]) * p
        ones.append(p[group[depth]])
        head = uniq[3][first[3]]
        top.append(((head >> np.uint64(8)).astype(np.int64) << 8 | (1 << i) | ((head & np.uint64(255)).astype(np.int64) >> (8 - i)), n - o, o, log_w))
    return Part(keys, ones, top)


def _merged(pdf: pd.DataFrame, depth: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    own = [unpack(a, np.uint64) for a in pdf["a"]]
    k = np.concatenate(own)
    n = np.concatenate([unpack(b, np.uint32) for b in pdf["b"]])
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.diff(k, prepend=~k[:1]) != 0)
    return own, k[first], np.add.reduceat(n, first)


def part_top(depth: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a part hands up: sums over its contexts of three bytes for each node of depth two, by the last byte."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, keys, counts = _merged(pdf, depth)
        codes, z, o, w = (np.concatenate(x) for x in zip(*weigh(keys, counts, depth).top, strict=True))
        node, back = np.unique(((codes >> 16) << 8) | (codes & 255), return_inverse=True)  # the third byte of context goes
        sums = np.stack([np.bincount(back, weights=x, minlength=node.size) for x in (z, o, w)])
        seen = sums[0] + sums[1] > 0
        node, sums = node[seen], sums[:, seen]
        cut = np.searchsorted(node >> 16, np.arange(257))
        out = [(int(c), (node[x] & 65535).astype(np.uint16).tobytes(), np.ascontiguousarray(sums[:, x]).tobytes()) for c in np.flatnonzero(np.diff(cut)) for x in [slice(cut[c], cut[c + 1])]]
        return pd.DataFrame(out, columns=["last", "a", "b"]).astype({"last": "int32"})

    return run


def last_byte(pdf: pd.DataFrame) -> pd.DataFrame:
    """Depths two and one under one last byte: a of ones and of zeros and b of each second byte, and what depth none needs."""
    from namesift.llm.ctw import _kt

    z2, o2, children2 = np.zeros((3, 65536))
    for a, b in zip(pdf["a"], pdf["b"], strict=True):
        at = np.frombuffer(a, np.uint16)
        z, o, w = np.frombuffer(b, float).reshape(3, -1)
        z2[at] += z
        o2[at] += o
        children2[at] += w
    z2, o2, children2 = (x.reshape(256, 256) for x in (z2, o2, children2))
    kt2, z1, o1 = _kt(z2, o2), z2.sum(0), o2.sum(0)
    own2 = 1 / (1 + np.exp(np.clip(children2 - kt2, -700, 700)))
    children1, kt1 = (np.logaddexp(kt2, children2) - _LN2).sum(0), _kt(z1, o1)
    own1 = 1 / (1 + np.exp(np.clip(children1 - kt1, -700, 700)))
    second = np.flatnonzero((z2 + o2).any(1))
    # the last row is for second bytes that were not seen: depth two predicts evenly
    b, a = np.vstack([(1 - own1) * (1 - own2[second]), np.zeros(256)]), []
    for n1, n2 in ((o1, o2), (z1, z2)):
        pred1, pred2 = (n1 + 0.5) / (o1 + z1 + 1), (n2 + 0.5) / (o2 + z2 + 1)
        a.append(np.vstack([own1 * pred1 + (1 - own1) * own2[second] * pred2[second], own1 * pred1 + (1 - own1) * 0.5]))
    w = np.stack([np.logaddexp(kt1, children1) - _LN2, z1, o1])
    return pd.DataFrame({"last": pdf["last"].iloc[:1].astype("int32"), "second": [second.astype(np.uint8).tobytes()], "p": [zlib.compress(np.stack([*a, b]).astype(np.float32).tobytes(), 1)], "w": [w.tobytes()]})


class Upper(NamedTuple):
    """a of ones, a of zeros and b of depths none to two: row[last byte, second byte] of tables with a column for each node."""

    row: np.ndarray
    ones: np.ndarray
    zeros: np.ndarray
    b: np.ndarray


def upper(rows: list) -> Upper:
    from namesift.llm.ctw import _kt

    w0, z0, o0 = np.zeros((3, 256))
    for r in rows:
        w, z, o = np.frombuffer(r["w"], float).reshape(3, 256)
        w0, z0, o0 = w0 + w, z0 + z, o0 + o
    own = 1 / (1 + np.exp(np.clip(w0 - _kt(z0, o0), -700, 700)))
    preds = [(x + 0.5) / (o0 + z0 + 1) for x in (o0, z0)]
    row = np.zeros((256, 256), np.int32)
    a, b, n = [[(own * pred + (1 - own) * 0.5)[None]] for pred in preds], [np.zeros((1, 256))], 1
    for r in rows:
        p = np.frombuffer(zlib.decompress(r["p"]), np.float32).reshape(3, -1, 256)
        second = np.frombuffer(r["second"], np.uint8)
        row[r["last"]] = n + second.size
        row[r["last"], second] = n + np.arange(second.size)
        n += second.size + 1
        for x, pred, own_p in zip(a, preds, p, strict=False):
            x.append(own * pred + (1 - own) * own_p)
        b.append((1 - own) * p[2])
    return Upper(row, *(np.vstack(x).astype(np.float32) for x in (*a, b)))


def part_scores(depth: int, model) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """log10 P(byte | context) for each block's keys of a part, in their order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, keys, counts = _merged(pdf, depth)
        part, up = weigh(keys, counts, depth), model.value
        row = up.row[(keys >> np.uint64(8 * depth)).astype(np.int64), ((keys >> np.uint64(8 * (depth - 1))) & np.uint64(255)).astype(np.int64)]
        byte, total = (keys & np.uint64(255)).astype(np.int64), np.zeros(keys.size)
        for i, p in enumerate(part.ones):
            node = (1 << i) | (byte >> (8 - i))
            bit, b = ((byte >> (7 - i)) & 1).astype(bool), up.b[row, node]
            total += np.log10(np.where(bit, up.ones[row, node] + b * p, up.zeros[row, node] + b * (1 - p)))
        total = total.astype(np.float32)
        return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "s": [pack(total[np.searchsorted(keys, x)]) for x in own]})

    return run


def pack_texts(keys: list[tuple], raw: list[bytes], before: list[bytes], last: list[bool]) -> tuple[bytes, bytes]:
    """(rows, lengths and ends; contexts and bytes) of a block's texts."""
    meta = np.array([[k[1], len(x), e] for k, x, e in zip(keys, raw, last, strict=True)], np.int64)
    return meta.tobytes(), zlib.compress(b"".join(b + x for b, x in zip(before, raw, strict=True)), 1)


def block_scores(parts: int, depth: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(mine: pd.DataFrame, scores: pd.DataFrame) -> pd.DataFrame:
        meta = np.frombuffer(mine["a"].iloc[0], np.int64).reshape(-1, 3)
        data, at, before, raw = zlib.decompress(mine["b"].iloc[0]), 0, [], []
        for n in meta[:, 1].tolist():
            before.append(data[at : at + depth])
            raw.append(data[at + depth : at + depth + n])
            at += depth + n
        keys, lens = keys_of(raw, before, meta[:, 2].astype(bool).tolist(), depth)
        uniq, back = np.unique(keys, return_inverse=True)
        order = np.argsort(part_of(uniq, parts, depth), kind="stable")
        by = scores.sort_values("part")["s"]
        value = np.empty(uniq.size)
        value[order] = np.concatenate([unpack(s, np.float32) for s in by])
        total = np.bincount(np.repeat(np.arange(lens.size), lens), weights=value[back], minlength=lens.size)
        return pd.DataFrame({"row": meta[:, 0], "score": total, "n_bytes": meta[:, 1]})

    return run
