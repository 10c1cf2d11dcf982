"""Byte-level BPE by speculate and verify.

Greedy longest match proposes the tokens of a word. A proposal equals the merge result exactly when every
adjacent pair of its tokens is one that merging would leave apart, so all pairs of a batch of new words are
tested at once with array operations. Only words with a failing pair go through the merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesift.llm.common import small_batches

#: The byte-level pre-tokenizer's split rule (a fixed value of the public format), for texts of the plain characters below.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Outside the Latin blocks, and for a few signs in them, Python's classes differ from the library's Unicode tables.
NOT_PLAIN = r"[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]"
#: Words, and texts between blanks, kept with their tokens in one Python worker.
CACHED_WORDS, CACHED_CHUNKS = 700_000, 400_000
#: Bytes of words kept with their packed ids, and what each takes besides its letters and ids: a worker keeps them through later stages.
CACHED_BYTES, _KEPT = 64 << 20, 190
#: Bytes of a word whose merges are made together with those of others; a rank past all merges.
SHORT, _LATE = 48, 1 << 60
#: Characters of a text that are cut into words at once.
PIECE = 1 << 20


def _byte_letters() -> dict[str, int]:
    """The format's letter for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for a tokenizer file of the tokenizers library with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(letters[x] for x in token)
        self.ids = {b: i for i, b in enumerate(self.bytes) if b}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        made = np.zeros(size, np.int64)
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = (model["vocab"][t] for t in (a, b, a + b))
            self.rank[x, y] = r, z
            self.left[z], self.right[z], made[z] = x, y, r + 1
        self.made = made  # 0 for a byte, else 1 + rank of the merge that makes the token
        keys = np.array([x * size + y for x, y in self.rank], np.int64)
        self.size, order = size, np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r + 1 for r, _ in self.rank.values()], np.int64)[order]
        self.pair_made = np.array([z for _, z in self.rank.values()], np.int64)[order]
        self.longest = max(map(len, self.ids))
        # lengths of the tokens of three and more bytes that begin with three bytes, longest first
        lengths: dict[bytes, set[int]] = {}
        for b in self.ids:
            if len(b) > 2:
                lengths.setdefault(b[:3], set()).add(len(b))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        self.split, self.not_plain = re.compile(SPLIT), re.compile(NOT_PLAIN)
        self.cut = re.compile(r"(?<=\S)(?= \S)")
        self.apart = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.path, self.library = path, None
        #: words and chunks with their ids as text; with their decoded bytes where these differ
        self.id_texts: dict[str, str] = {}
        self.changed: dict[str, bytes] = {}
        self.chunk_ids: dict[str, str] = {}
        self.chunk_changed: dict[str, bytes] = {}
        self.packed: dict[str, bytes] = {}
        self.packed_bytes = 0

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, ids, lengths = [], 0, len(word), self.ids, self.lengths
        if (whole := ids.get(word)) is not None:
            return [whole]
        while at < n:
            for k in lengths.get(word[at : at + 3], ()):
                if at + k <= n and (i := ids.get(word[at : at + k])) is not None:
                    break
            else:
                k = 2
                if at + 2 > n or (i := ids.get(word[at : at + 2])) is None:
                    k, i = 1, self.single[word[at]]
            out.append(i)
            at += k
        return out

    def apart_under_merging(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a[i] and b[i] together gives just those two tokens.

        Both tokens are taken apart from the latest merge back. At each state the tokens that touch could have
        merged before the parts around them did if their merge comes earlier than the merge last undone.
        """
        ok = np.ones(a.size, bool)
        live = np.arange(a.size)
        l, r = a.copy(), b.copy()
        #: a merge over the border at this rank or later comes too late to happen
        before = np.full(a.size, np.iinfo(np.int64).max)
        while live.size:
            at = np.minimum(np.searchsorted(self.pair_keys, key := l * self.size + r), self.pair_keys.size - 1)
            merged = np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.iinfo(np.int64).max)
            bad = merged < before
            ok[live[bad]] = False
            l_made, r_made = self.made[l], self.made[r]
            done = bad | ((l_made == 0) & (r_made == 0))
            take_left = l_made > r_made
            # a merge over the border wins a tie of ranks against one that starts further right
            before = np.where(take_left, l_made, r_made + 1)
            l, r = np.where(take_left, self.right[l], l), np.where(take_left, r, self.left[r])
            live, l, r, before = live[~done], l[~done], r[~done], before[~done]
        return ok

    def merge(self, word: bytes) -> list[int]:
        """The merges in order of rank, then place."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != x or ids[j] != y:
                continue
            ids[i], gone[j], after[i] = z, True, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := self.rank.get((z, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, z, ids[after[i]], m[1]))
            if (p := before[i]) >= 0 and (m := self.rank.get((ids[p], z))):
                heapq.heappush(heap, (m[0], p, ids[p], z, m[1]))
        return [t for t, g in zip(ids, gone, strict=True) if not g]

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """merge() of many short words: each round makes the first merge of least rank in every word that has one."""
        tok = np.array(self.single, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank, made = np.full(tok.size, _LATE), np.zeros(tok.size, np.int64)
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def look(at: np.ndarray) -> None:
            """Ranks of the pairs that begin at these places."""
            at = at[(at >= 0) & (at + 1 < tok.size)]
            key = tok[at] * self.size + tok[at + 1]
            found = np.minimum(np.searchsorted(self.pair_keys, key), self.pair_keys.size - 1)
            some = (self.pair_keys[found] == key) & (of[at] == of[at + 1])
            rank[at], made[at] = np.where(some, self.pair_ranks[found], _LATE), self.pair_made[found]

        look(np.arange(tok.size))
        while tok.size:
            first = np.flatnonzero(np.diff(of, prepend=-1) != 0)
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, tok.size)))
            done = least == _LATE
            if done.any():
                out.append((of[done], tok[done]))
                tok, of, rank, made, least = tok[~done], of[~done], rank[~done], made[~done], least[~done]
            at = np.flatnonzero(rank == least)
            at = at[np.diff(of[at], prepend=-1) != 0]
            tok[at] = made[at]
            left = np.ones(tok.size, bool)
            left[at + 1] = False
            tok, of, rank, made = tok[left], of[left], rank[left], made[left]
            at -= np.arange(at.size)
            rank[at[at == tok.size - 1]] = _LATE
            look(np.concatenate([at, at - 1]))
        of, tok = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2
        order = np.argsort(of, kind="stable")
        return [x.tolist() for x in np.split(tok[order], np.searchsorted(of[order], np.arange(1, len(words))))]

    def words(self, new: list[str]) -> tuple[list[list[int]], int]:
        """The tokens of each word, and how many words failed the check."""
        if not new:
            return [], 0
        raw = [w.encode() for w in new]
        ids = [self.propose(w) for w in raw]
        n = np.array([len(x) for x in ids])
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(n.sum()))
        inside = np.ones(max(0, flat.size - 1), bool)
        inside[np.cumsum(n)[:-1] - 1] = False
        a, b = flat[:-1][inside], flat[1:][inside]
        keys, back = np.unique(a * self.size + b, return_inverse=True)
        ok = self.apart_under_merging(keys // self.size, keys % self.size)[back] if keys.size else np.empty(0, bool)
        of = np.repeat(np.arange(len(new)), n - 1)
        failed = np.unique(of[~ok])
        short = [i for i in failed.tolist() if len(raw[i]) <= SHORT]
        for i, x in zip(short, self.merge_all([raw[i] for i in short]) if short else (), strict=True):
            ids[i] = x
        for i in failed.tolist():
            if len(raw[i]) > SHORT:
                ids[i] = self.merge(raw[i])
        return ids, failed.size

    def _pieces(self, text: str) -> Iterator[str]:
        """Parts of at most about PIECE characters, cut before a space that follows other text: no word spans such a place."""
        at = 0
        while len(text) - at > PIECE and (m := self.cut.search(text, at + PIECE)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Pieces of a text, and whether the piece is one special token."""
        for i, part in enumerate(self.apart.split(text) if self._special_in(text) else [text]):
            if i % 2:
                yield part, True
            elif part:
                for piece in self._pieces(part):
                    yield piece, False

    def pre_tokens(self, text: str) -> list[str]:
        """Words by the split rule; the library's own tables decide where Python's classes may differ from them."""
        if not self.not_plain.search(text):
            return self.split.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def _learn(self, words: Iterable[str]) -> None:
        """Have the tokens of these words at hand, and whether decoding them gives the words again."""
        new = [w for w in words if w not in self.id_texts]
        if len(self.id_texts) + len(new) > CACHED_WORDS:
            self.id_texts.clear()
            self.changed.clear()
            new = list(words)
        for w, ids in zip(new, self.words(new)[0], strict=True):
            self.id_texts[w] = ",".join(map(str, ids))
            if (raw := self.decode_bytes(ids)) != w.encode():
                self.changed[w] = raw

    @staticmethod
    def _chunks(text: str) -> list[str]:
        """text cut before each blank that something else than a blank follows: no word spans such a place, and none depends on what lies past it."""
        first, *rest = text.split(" ")
        if "" not in rest:
            return [first, *(" " + c for c in rest)] if first else [" " + c for c in rest]
        out, held = [], first
        for c in rest:
            if c:
                if held:
                    out.append(held)
                held = " " + c
            else:
                held += " "
        return [*out, held] if held else out

    def _digest(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """The decimal ids of each text, joined by commas, and its decoded bytes; learns all new chunks of these texts together."""
        split = [self._chunks(t) for t in texts]
        every = set().union(*split)
        new = [c for c in every if c not in self.chunk_ids]
        if len(self.chunk_ids) + len(new) > CACHED_CHUNKS:
            self.chunk_ids.clear()
            self.chunk_changed.clear()
            new = list(every)
        words = [self.pre_tokens(c) for c in new]
        self._learn({w for ws in words for w in ws})
        ids = self.id_texts.__getitem__
        for c, ws in zip(new, words, strict=True):
            self.chunk_ids[c] = ",".join(map(ids, ws))
            if self.changed and not self.changed.keys().isdisjoint(ws):
                self.chunk_changed[c] = b"".join(self.changed.get(w) or w.encode() for w in ws)
        get = self.chunk_ids.__getitem__
        return [(",".join(map(get, s)), t.encode() if self.chunk_changed.keys().isdisjoint(s) else b"".join(self.chunk_changed.get(c) or c.encode() for c in s)) for s, t in zip(split, texts, strict=True)]

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """digest() of each text; the new words of many short texts are learnt together."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
                size += len(texts[end])
                end += 1
            plain = [t for t in texts[at:end] if not self._special_in(t)] if size <= PIECE else []
            known = iter(self._digest(plain) if plain else [])
            for t in texts[at:end]:
                if size > PIECE or self._special_in(t):
                    yield self.digest(self.parts(t))
                else:
                    ids, raw = next(known)
                    yield ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()
            at = end

    def _special_in(self, text: str) -> bool:
        return any(x in text for x in self.special)

    def encode(self, text: str) -> np.ndarray:
        out = []
        for piece, special in self.parts(text):
            if special:
                out.append(np.array([self.special[piece]], np.int32).tobytes())
                continue
            words = self.pre_tokens(piece)
            new = [w for w in set(words) if w not in self.packed]
            if self.packed_bytes > CACHED_BYTES:
                self.packed.clear()
                self.packed_bytes = 0
                new = list(set(words))
            for w, ids in zip(new, self.words(new)[0], strict=True):
                self.packed[w] = np.array(ids, np.int32).tobytes()
                self.packed_bytes += _KEPT + len(w) + 4 * len(ids)
            out.append(b"".join(map(self.packed.__getitem__, words)))
        return np.frombuffer(b"".join(out), np.int32)

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """As the byte-level decoder does: the tokens' bytes, with U+FFFD for what is not UTF-8."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def digest(self, parts: Iterable[tuple[str, bool]]) -> tuple[int, str, str]:
        """(tokens, sha256 of the decimal ids joined by commas, sha256 of the decoded text)."""
        ids_sha, text_sha, n = hashlib.sha256(), hashlib.sha256(), 0
        for piece, special in parts:
            ids, raw = (str(self.special[piece]), piece.encode()) if special else self._digest([piece])[0]
            if ids:
                ids_sha.update(b"," * bool(n) + ids.encode())
                n += ids.count(",") + 1
                text_sha.update(raw)
        return n, ids_sha.hexdigest(), text_sha.hexdigest()


def _codec(path: str, held: dict = {}) -> Codec:  # noqa: B006  one for each Python worker
    if path not in held:
        held[path] = Codec(path)
    return held[path]


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with an array<int> column of token ids. Null counts as empty and gives an empty array; other columns stay."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in batches:
            ids = [codec.encode(t or "") for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            keep = [i for i, f in enumerate(b.schema.names) if f != out]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))], [*(b.schema.names[i] for i in keep), out])

    return docs.mapInArrow(run, docs.drop(out).withColumn(out, F.lit(None).cast("array<int>")).schema)


def decode(docs: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """docs with the text of the token ids. A null array gives null; other columns stay."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in batches:
            texts = [None if x is None else codec.decode(x) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            keep = [i for i, f in enumerate(b.schema.names) if f != out]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(texts, pa.string())], [*(b.schema.names[i] for i in keep), out])

    return docs.mapInArrow(run, docs.drop(out).withColumn(out, F.lit(None).cast("string")).schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document: encoded, decoded, and only the digests kept.

    One row for each input row, repeated ids included. A null or empty text has no tokens; its digests are of the
    empty string. Very long texts are cut into words piece by piece.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in batches:
            n, ids, text = zip(*codec.digests([t or "" for t in b.column(1).to_pylist()]), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
