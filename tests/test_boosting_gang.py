"""Rounds in one barrier stage: the trees of one block, with many nodes on a level,
with held-out rows and patience, and of the aggregate per level; bounded files."""

import os

import numpy as np
import pytest

from corvid.operators import boosting as B
from corvid.operators import prep
from corvid.session import ensure_checkpoint_dir
from corvid.sources import views
from tests.conftest import SF_SMALL

FEATS = views.OBS_FEATURES


@pytest.fixture(scope="module")
def folded(spark):
    sp = prep.stratified_split(views.sig(spark, SF_SMALL), test_size=0.2, seed=42)
    return prep.kfold(sp, 3).cache()


@pytest.mark.parametrize("p", [B.Params(4, 7, 0.3, bins=32, l2=0.0, min_rows=2), B.Params(30, 4, 0.5, bins=32, patience=3),
                               B.Params(6, 1, kind="samme", bins=32)], ids=["deep", "patience", "stumps"])
def test_one_stage_has_the_trees_of_one_block_and_of_aggregates(spark, folded, monkeypatch, p):
    def fit(**kw):
        return [m.as_dict() for m in B.fit(folded, FEATS, "x", p, folds=("fold", 3), held=folded["split"] == "test", **kw)]

    one = fit()
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("gang", "")
    many = fit(block=200)
    assert len(jobs.getJobIdsForGroup("gang")) < 20          # one job for each level and round before
    spark.sparkContext.setJobGroup("rest", "")
    assert many == one and any(m["trees"] for m in one)
    if p.patience is None:
        monkeypatch.setattr(B, "_slots", lambda s: 0)
        assert fit(block=200) == one


def test_files_do_not_pile_up(spark, folded):
    at = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    B.fit(folded, FEATS, "x", B.Params(8, 4, bins=32), block=200)
    new = [os.path.join(d, f) for x in set(os.listdir(at)) - before if x.startswith("boosting-") for d, _, fs in os.walk(os.path.join(at, x)) for f in fs]
    assert 0 < len([f for f in new if not f.endswith(".crc")]) <= 8      # the last file of every task


def _random_rows(n, f, n_bins):
    rnd = np.random.default_rng(5)
    bins = rnd.integers(0, n_bins, (f, n)).astype(np.uint8)
    y = ((bins[0] > n_bins // 2) ^ (rnd.random(n) < 0.2)).astype(np.uint8)
    return bins, y, np.rint((0.5 - y + bins[1] / 100) * B.UNIT), np.rint(rnd.random(n) * B.UNIT)


def test_what_is_below_nodes_is_found_from_their_rows(tmp_path):
    f, n_bins, p = 3, 20, B.Params(1, 5, 0.3, l2=0.0, min_rows=2)
    bins, y, g, h = _random_rows(900, f, n_bins)
    raw = dict(n=900, bins=bins.tobytes(), y=y.tobytes(), fold=b"\xff" * 900, held=b"\0" * 900, score=b"")
    trees, sent = [], []
    for ahead in (False, True):
        block, fit, tree = B.Block([raw], f, 1), B.Fit(None, 0.0, (1.0, 1.0)), B.Tree()
        for level in range(p.depth):
            if ahead and level == 2:
                gang = B.Gang(f"file://{tmp_path}", 0, 1)
                put = gang.put
                gang.put = lambda x: (sent.append(len(x)), put(x))
                below = gang.below(block.frontier_rows(0, fit, tree, p), f, p, [3] * len(fit.frontier), n_bins)
                for k in range(3):
                    B._grown(tree, fit, [s for x in below if len(x) > k for s in x[k]])
                break
            B._grown(tree, fit, B.best_splits(block.sums(0, fit, tree, p, n_bins), p))
        block.add(0, fit, tree, p)
        trees.append((tree, block.score.tolist()))
    assert trees[0] == trees[1] and len(tree.feature) > 40
    assert sent[0] == 8 + 4 * 8 + 900 * (f + 16)         # the rows once, however many levels


def test_stumps_take_one_sum_of_weights_and_deep_trees_score_alike():
    bins, y, g, h = _random_rows(40_000, 3, 20)
    a = B.cell_sums(bins, y, np.where(y > 0, h, 0.0), h, None, None, 20)
    assert (a == B.cell_sums(bins, y, None, h, None, None, 20, a[0, :, :, 2])).all() and a[0, 1, :, 2].sum() == 40_000
    tree, fit = B.Tree(), B.Fit(None, 0.0, (1.0, 1.0))
    p = B.Params(depth=6, l2=0.0)
    for splits in B.levels_below([(bins, g, h)], p, 6, 20)[0]:
        B._grown(tree, fit, splits)
    plain = [0] * 40_000
    for r in range(0, 40_000, 997):
        node = 0
        while tree.feature[node] >= 0:
            node = tree.left[node] + int(bins[tree.feature[node], r] > tree.bin[node])
        plain[r] = tree.value[node]
    got = tree.score(bins)
    assert len(tree.feature) > 2 * B.FEW_SPLITS + 1 and all(got[r] == plain[r] for r in range(0, 40_000, 997))


def test_models_share_steps_as_far_as_there_is_room():
    assert B.Plan(12, 900_000, B.Params(depth=3), 7, 257).together(5) == 5
    assert B.Plan(12, 900_000, B.Params(depth=10), 7, 257).together(5) > 1
    assert B.Plan(12, 10 ** 9, B.Params(depth=3), 7, 257).together(5) == 1
    assert not B.Plan(12, 10 ** 9, B.Params(depth=10), 7, 257).owned(512, 5)     # rows would not fit a task
