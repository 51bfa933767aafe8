import numpy as np
import pytest

from lorekit.llm import hashsets


@pytest.mark.parametrize("width", [0, 1, 3, 8, 17, 31, 53, 64])
def test_packed_sets_come_back(width):
    r = np.random.default_rng(width)
    for n in (0, 1, 2, 3, 100, 5000):
        values = np.unique(r.integers(0, (1 << width) - 1, n, np.uint64, endpoint=True))
        packed = hashsets.pack(values, width)
        assert hashsets.unpack(packed, len(values), width).tolist() == values.tolist()
        assert len(packed) * 8 <= len(values) * (max(0, width - np.log2(max(1, len(values)))) + 3) + 16


def test_ranges_and_sums():
    r = np.random.default_rng(3)
    values = np.sort(r.integers(0, 1 << 64, 1000, np.uint64))
    for width, bits in ((20, 0), (20, 4), (20, 20), (64, 3)):
        tops = hashsets.tops(values, width)
        edges = hashsets.edges(tops, width, bits)
        assert len(edges) == (1 << bits) + 1 and edges[0] == 0
        assert [int(x) >> (width - bits) for x in tops] == [b for b, n in enumerate(np.diff(edges)) for _ in range(n)]
    few = r.integers(0, 50, 60).astype(np.uint64)
    numbers = r.integers(1, 9, 60)
    assert hashsets.totals(few, numbers).tolist() == [int(numbers[few == x].sum()) for x in few]
    assert hashsets.repeated(few).tolist() == [bool((few == x).sum() > 1) for x in few]
    assert not len(hashsets.totals(few[:0], numbers[:0])) and not len(hashsets.repeated(few[:0]))
    marks = few > 20
    assert hashsets.unpack_marks(hashsets.pack_marks(marks), len(marks)).tolist() == marks.tolist()
