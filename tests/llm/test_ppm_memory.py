"""What a Python process holds of a block of the byte trie."""

from __future__ import annotations

import numpy as np

from probitas.llm import ppm


def _entries(count: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(1)
    text = bytes(r.choice(np.frombuffer(b"etaoin shrdlu", dtype=np.uint8), size=count).tolist())
    codes, n = np.unique(np.concatenate([c for _, c in ppm.code_runs([text])]), return_counts=True)
    return codes.astype(np.int64), n.astype(np.int64)


def test_levels_are_small_and_exact():
    codes, n = _entries()
    n = n + (np.arange(len(n)) == 7) * (1 << 40)  # a count that needs eight bytes is kept whole
    two = codes & ((1 << 24) - 1)
    by = np.argsort(two, kind="stable")
    top = ppm.deeper(codes, n, ppm.levels(*ppm._sums(two[by], n[by])), ppm.ORDER)
    assert int(top.n[7]) == int(n[7]) and int(top.total.sum()) == int(n.sum())
    p = top.log10p(codes)
    ctx = codes >> 8
    total, kinds = ({c: v for c, v in zip(*ppm._sums(ctx, x), strict=True)} for x in (n, np.ones_like(n)))
    assert np.allclose(p, [np.log10(v / (total[c] + kinds[c])) for c, v in zip(ctx, n, strict=True)], rtol=0, atol=1e-12)


def test_a_broadcast_block_is_packed():
    codes, n = _entries()
    packed = ppm._packed(codes, n)
    assert len(packed[0]) + len(packed[1]) < (codes.nbytes + n.nbytes) // 2
    back = ppm._unpacked(*packed)
    assert np.array_equal(back[0], codes) and np.array_equal(back[1], n)
    empty = ppm._unpacked(*ppm._packed(codes[:0], n[:0]))
    assert len(empty[0]) == len(empty[1]) == 0
    two = codes & ((1 << 24) - 1)
    by = np.argsort(two, kind="stable")
    top = ppm.deeper(codes, n, ppm.levels(*ppm._sums(two[by], n[by])), ppm.ORDER)
    held = sum(x.nbytes for x in (top.total, top.kinds, top.rest_total, top.rest_kinds))
    assert held <= 16 * len(top.ctx)  # 32 a context before
