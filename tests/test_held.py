"""Keywords that texts hold, against a test per keyword."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from postpulse.operators import held as H

BYTES = [b"a", b"b", b" ", b"\n", b"\xc3", b"\xff", b"\x1c"]


def counted(texts, keywords):
    whole, half = pa.record_batch({"text": pa.array(texts, pa.binary())}), len(texts) // 2
    shared = SimpleNamespace(value=H.Keywords(keywords))
    found = [pair for batch in H.count_held([whole[:half], whole[half:]], shared)
             for pair in zip(*batch.to_pydict().values(), strict=True)]
    assert len(found) == len(dict(found))
    return dict(found)


@pytest.mark.parametrize("tight", [False, True])
def test_counts_are_those_of_a_test_per_keyword(monkeypatch, tight):
    """``tight``: keywords of the same bytes share a hash, nothing fits in one step, little is kept."""
    if tight:
        for name, value in {"FACTOR": np.uint64(1), "CHUNK": 7, "SLICE": 20, "KNOWN": 3, "LONGEST": 4}.items():
            monkeypatch.setattr(H, name, value)
    rng = random.Random(3)
    for _ in range(60):
        texts = [b"".join(rng.choices(BYTES, k=rng.randint(0, 60))) for _ in range(30)]
        texts += [None, b"", b"   ", b"a" * 300, texts[0]]
        keywords = [b"".join(rng.choices(BYTES, k=rng.randint(0, 6))) for _ in range(60)] + [b"a" * 40]
        want = {k: sum(t is not None and k in t for t in texts) for k in keywords}
        assert counted(texts, keywords) == {k: n for k, n in want.items() if n}


def test_no_texts_and_no_keywords():
    assert counted([], [b"a", b"", b"a b"]) == {}
    assert counted([b"a b", None], []) == {}
    assert counted([None, None], [b"a", b""]) == {}
