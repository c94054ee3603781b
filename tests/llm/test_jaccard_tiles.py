"""Bitmaps of parities, and pairs listed in the first tile that they share."""

import numpy as np
import pyarrow as pa

from verisift.llm import jaccard_join as J


def test_common_elements_cancel_out():
    h = np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64)
    for k in (0, 1, 40):
        x, y = h[: len(h) - k], h[k:]
        assert k == 0 or J.bits_apart(J.bitmap(x), J.bitmap(y)) > 0
        assert J.bits_apart(J.bitmap(x), J.bitmap(y)) <= len(np.setxor1d(x, y))


def test_a_pair_is_listed_in_the_smallest_tile_it_shares():
    bits = J.bitmap(np.arange(1, 101, dtype=np.uint64) << np.uint64(9)).tobytes()
    tiles = {1: [5, 9], 2: [5, 9], 3: [9]}

    def listed(key: int, docs: list[int]) -> set[tuple[int, int]]:
        n = len(docs)
        group = pa.table({"key": [key] * n, "i": [0] * n, "j": [0] * n, "side": [2] * n, "doc": docs, "comp": docs, "n": [100] * n, "bits": [bits] * n, "tiles": [tiles[d] for d in docs]})
        made = J._compare(85, J.ALL)(group).to_pydict()
        return set(zip(made["a"], made["b"], strict=True))

    assert listed(5, [1, 2]) == {(1, 2)}
    assert listed(9, [1, 2, 3]) == {(1, 3), (2, 3)}
