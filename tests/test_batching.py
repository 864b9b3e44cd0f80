"""Greedy batches against the plain loop."""

import random

import pytest

from gradeflow.operators.batching import _cuts, _stretches, size_batches


def plain(sizes, limit):
    batch, held, out = 1, 0, []
    for i, size in enumerate(sizes):
        if i and held + size > limit:
            batch, held = batch + 1, 0
        held += size
        out.append(batch)
    return out


def test_three_of_ten_megabytes(spark):
    mb = 1024 * 1024
    frame = spark.createDataFrame([("d", i, 10 * mb) for i in range(3)], "dataset_id string, file_id int, file_size bigint")
    got = sorted((r["file_id"], r["batch_no"]) for r in size_batches(frame).collect())
    assert got == [(0, 1), (1, 1), (2, 2)]


@pytest.mark.parametrize("seed", range(6))
def test_matches_the_loop(spark, seed):
    rng = random.Random(seed)
    limit = rng.choice([10, 100, 1000])
    datasets = {
        f"d{d}": [rng.choice([0, 1, rng.randrange(limit), rng.randrange(limit // 3 + 1), limit, limit + 5]) for _ in range(n)]
        for d, n in enumerate([1, 3, 40, 400])
    }
    rows = [(name, i, size) for name, sizes in datasets.items() for i, size in enumerate(sizes)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "dataset_id string, file_id int, file_size bigint")
    got = {(r["dataset_id"], r["file_id"]): r["batch_no"] for r in size_batches(frame, limit=limit, block=rng.choice([1, 2, 7, 64])).collect()}
    for name, sizes in datasets.items():
        assert [got[name, i] for i in range(len(sizes))] == plain(sizes, limit), (name, limit)


def test_block_summary_matches_replay():
    import numpy as np

    rng = random.Random(7)
    for _ in range(300):
        limit = rng.randrange(1, 60)
        ends = np.cumsum([rng.choice([0, rng.randrange(limit + 10)]) for _ in range(rng.randrange(1, 30))])
        acts = _stretches(ends, limit)
        for carry in range(0, limit + 15):
            cuts = _cuts(ends, carry, limit)
            top, count, out = next(a for a in acts if a[0] >= carry)
            assert count == len(cuts)
            if cuts:
                start = cuts[-1]
                assert out == int(ends[-1]) - (int(ends[start - 1]) if start else 0)
            else:
                assert out == -1
