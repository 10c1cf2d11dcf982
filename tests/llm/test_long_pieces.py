from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from namesift.llm import blocks, ctw


def test_pieces_teach_what_the_whole_text_does(monkeypatch):
    """A text of over BLOCK bytes is counted in pieces with its own contexts and one end mark."""
    monkeypatch.setattr(blocks, "BLOCK", 40)
    monkeypatch.setattr(ctw, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = ["the of and a text of more than forty bytes, " * 5, "short", "", "held out " * 20]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(texts), pa.array([True, True, True, False]), pa.array([1, 2, 3, 4])], ["doc_id", "text", "train", "hash"])
    counts = np.zeros(1 << 24, np.int64)
    for out in ctw._gather(64, 2, 64)(iter([batch])):
        for r in out.to_pylist():
            if r["kind"] == ctw._TREE:
                counts[(r["part"] << 16) + ctw._unpack(r["a"], np.uint16).astype(np.int64)] += ctw._unpack(r["b"], np.int64)
    want = np.bincount(ctw._codes([t.encode() for t in texts[:3]])[0], minlength=1 << 24)
    assert (counts == want).all()
