"""What a Python worker holds on to while later stages run beside it."""

import numpy as np

from namesift.llm import blocks, bpe, quality
from namesift.llm.queries import tokenizer_path


def test_packed_words_are_bounded_by_bytes(monkeypatch):
    codec, plain = bpe.Codec(tokenizer_path()), bpe.Codec(tokenizer_path())
    monkeypatch.setattr(bpe, "CACHED_BYTES", 20_000)
    for i in range(20):
        text = " ".join(f"w{'x' * (k % 30)}{chr(97 + i)}" for k in range(40))
        assert codec.encode(text).tolist() == plain.encode(text).tolist()
        assert sum(len(w) + len(x) for w, x in codec.packed.items()) <= 30_000
    assert len(codec.packed) < 150


def test_powers_grow_with_the_texts(monkeypatch):
    monkeypatch.setattr(blocks._Powers, "up", np.ones(1, np.uint64))
    monkeypatch.setattr(blocks._Powers, "down", np.ones(1, np.uint64))
    small = blocks.words([b"one two three", b"two"], False)
    assert blocks._Powers.up.size <= 64 and small.hashes[1] == small.hashes[3]
    assert blocks.words([b"x " * 500 + b"two"], False).hashes[-1] == small.hashes[1] and blocks._Powers.up.size <= 2048


def test_texts_scored_at_once_are_bounded(spark, monkeypatch, tmp_path):
    """256 texts of 8 KB: their counts and letters were held 4 MB at a time, and are now 1 MB."""
    terms = quality.terms

    def seen(raw):
        assert sum(map(len, raw)) + len(raw) * 4 * quality._TERMS <= 1 << 20
        return terms(raw)

    voter = quality.Voter(terms([b"good text here", b"bad"]), np.array([1, 0], np.float32))
    want = voter.vote(terms([b"good text " * 800]))[0]
    docs = spark.createDataFrame([(i, "good text " * 800) for i in range(256)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(quality, "terms", seen)
    rows = list(_run(quality.score, docs, voter))
    assert len(rows) == 256 and all(abs(s - want) < 1e-6 for s in rows)


def _run(score, docs, voter):
    """The scores as a task makes them, in this process, where terms() is watched."""
    import pyarrow as pa

    class Docs:
        sparkSession, columns = docs.sparkSession, docs.columns

        def drop(self, *names):
            return self

        def withColumns(self, new):
            return docs.withColumns(new)

        def mapInArrow(self, run, schema):
            return [s for b in run(iter(pa.Table.from_pylist([r.asDict() for r in docs.collect()]).to_batches())) for s in b.column(2).to_pylist()]

    return score(Docs(), voter)
