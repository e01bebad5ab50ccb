from __future__ import annotations

import zlib

import numpy as np
import pytest

from lexigrid.llm import mixing_coder


def test_every_step_is_learnt():
    model, random = mixing_coder._Model(50), np.random.default_rng(2)
    last = before = np.zeros(64, np.int64)
    for step in range(30):
        ids, was = random.integers(0, 50, 64), model.seen[1].sum()
        model.predict(last, before)
        model.span(ids)
        model.learn(ids)
        assert model.seen[1].sum() == was + 64, step
        last, before = ids, last


def _markov(n: int) -> np.ndarray:
    """Ids of which most follow from the two before, in 300 ways, or else from the one before."""
    rng = np.random.default_rng(5)
    nexts, ids = rng.integers(0, 500, (500, 8)), [1, 2]
    for draw, pick, odd in zip(rng.random(n), rng.integers(0, 8, n), rng.integers(0, 500, n), strict=True):
        by_two = (ids[-1] * 7 + ids[-2] * 13) % 500
        ids.append(int(by_two if draw < 0.4 else nexts[ids[-1], pick] if draw < 0.95 else odd))
    return np.array(ids, np.uint32)


def test_each_order_saves_bytes(monkeypatch):
    ids = _markov(200_000)
    whole = len(mixing_coder.encode_block([1], [ids]))
    shares = np.bincount(ids) / len(ids)
    assert whole < 0.8 * len(ids) * -np.sum(shares[shares > 0] * np.log2(shares[shares > 0])) / 8

    predict = mixing_coder._Model.predict

    def without_two(self, last, before):
        predict(self, last, before)
        self.sum, self.mass2 = self.sum - self.mass2, self.mass2 * 0

    with monkeypatch.context() as patch:
        patch.setattr(mixing_coder._Model, "predict", without_two)
        block = mixing_coder.encode_block([1], [ids])
        assert len(block) > 1.01 * whole
        np.testing.assert_array_equal(mixing_coder.decode_block(block)[1][0], ids)
    with monkeypatch.context() as patch:
        patch.setattr(mixing_coder._Pairs, "rebuild", lambda self, met, total, odds: None)
        patch.setattr(mixing_coder._Pairs, "values", lambda self, cum: None)
        block = mixing_coder.encode_block([1], [ids])
        assert len(block) > 1.1 * whole
        np.testing.assert_array_equal(mixing_coder.decode_block(block)[1][0], ids)


def test_few_and_wide_ids():
    rng = np.random.default_rng(3)
    for ids in ([7], [0, 0, 0], [0] * 5000, rng.integers(0, 49408, 9000), rng.integers(0, 120_000, 3000), np.arange(4000) % 3):
        ids = np.array(ids, np.uint32)
        np.testing.assert_array_equal(mixing_coder.decode_block(mixing_coder.encode_block([1], [ids]))[1][0], ids)


def _squares(n: int, top: int) -> np.ndarray:
    return ((np.arange(n, dtype=np.int64) ** 2 // 7) % top).astype(np.uint32)


def test_searches_follow_one_order(monkeypatch):
    """A step sorts its contexts once, as numbers; places are not sorted for each search, nor for the pairs of a block."""
    monkeypatch.setattr(np, "argsort", None)
    ids = _squares(70_000, 500)
    np.testing.assert_array_equal(mixing_coder.decode_block(mixing_coder.encode_block([1], [ids]))[1][0], ids)
    monkeypatch.setattr(np, "unique", None)
    mixing_coder._encode_lanes(ids.astype(np.int64), 500)


@pytest.mark.parametrize(("n", "top"), [(1, 1), (2, 1), (5000, 3), (70_000, 500), (4096, 1 << 26), (4097, 1 << 31)])
def test_distinct_keys(n, top):
    keys = (_squares(n, top).astype(np.int64) * top + _squares(n, 3)).reshape(1, -1)
    known, places = mixing_coder._distinct(keys, top * top + 2)
    np.testing.assert_array_equal(known, np.unique(keys))
    np.testing.assert_array_equal(known[places], keys)


def test_coded_bytes_stay():
    """Blocks that were written stay readable: their bytes are those of the first coder of this kind."""
    assert [zlib.crc32(mixing_coder._encode_lanes(_squares(n, top).astype(np.int64), top)[1]) for n, top in ((1, 1), (9000, 40), (70_000, 500), (30_001, 50_000))] == CODED


CODED = [2057204230, 3439836596, 2927095990, 3844777799]
