"""What a worker knows of pieces: places of pieces of any bytes, taken out of Arrow at once."""

import numpy as np
import pyarrow as pa

from quillon.llm import _bpe
from quillon.llm._pieces import Known


class Words:
    """Distinct pieces that aren't to be made into Python objects one by one."""

    def __init__(self, words: pa.Array):
        self.words = words

    def __len__(self) -> int:
        return len(self.words)

    def to_numpy(self, zero_copy_only: bool) -> np.ndarray:
        return self.words.to_numpy(zero_copy_only=zero_copy_only)

    def take(self, at: pa.Array) -> pa.Array:
        return self.words.take(at)


class Learnt(Known):
    def forget(self) -> None:
        super().forget()
        self.words = []

    def learn(self, words: pa.Array) -> None:
        self.words += words.to_pylist()


def test_places_of_any_bytes(monkeypatch):
    cut = _bpe.distinct
    monkeypatch.setattr(_bpe, "distinct", lambda *a: (cut(*a)[0], Words(cut(*a)[1])))
    known = Learnt()
    for texts in ([b"a", b"a\0", b"\0", b"\0\0", b"a", "é　".encode()], [b"a\0\0", b"\0", b"b", b"a\0", b"b"], []):
        starts = np.cumsum([0, *map(len, texts)])[:-1].astype(np.int64) if texts else np.zeros(0, np.int64)
        at = known.places(b"".join(texts), starts)
        assert [known.words[k] for k in at.tolist()] == texts
    assert len(set(known.words)) == len(known.words) == 7
