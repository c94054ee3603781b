"""What the answers of a hash range cost."""

import time

import numpy as np
import pyarrow as pa

from verisift.llm import substring_dedup
from verisift.llm.common import pack, pack_sorted


def test_anchors_cost_by_their_blocks():
    """One hash range of many tasks: the work follows the hashes, however many rows they come in."""
    rng = np.random.default_rng(1)
    met = np.unique(rng.integers(0, 1 << 40, 100_000).astype(np.uint64))
    ids = rng.integers(0, 1 << 40, 20_000).astype(np.int64)

    def group(rows: int) -> pa.Table:
        made = []
        for i, (p, d) in enumerate(zip(np.array_split(np.sort(met), rows), np.array_split(ids, rows), strict=True)):
            blocks = np.sort(rng.choice(met, len(d)) + (np.arange(len(d)) % 2).astype(np.uint64))
            made.append((0, pack_sorted(p), np.packbits(np.ones(len(p), np.uint8)).tobytes(), pack_sorted(blocks), pack(d), pack(np.full(len(d), i, np.int32))))
        return pa.table(dict(zip(("range", "probes", "repeated", "blocks", "doc_ids", "places"), map(list, zip(*made, strict=True)), strict=True)))

    run, spent, found = substring_dedup._answer_anchors(64), [], []
    for rows in (1, 400):
        g = group(rows)
        run(g)
        began = time.process_time()
        out = run(g)
        spent.append(time.process_time() - began)
        found.append(sum(len(substring_dedup.unpack(x)) for x in out.column("places").to_pylist()))
    assert 9_000 < found[0] < 11_100 and 9_000 < found[1] < 11_100
    assert spent[1] < 6 * spent[0] + 0.3
