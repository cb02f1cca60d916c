"""Exact greedy size rotation equals a sequential fold, whatever the chunking."""

import random

from eventloom.operators import rotation


def _fold(sizes, limit):
    seg, acc, out = 0, 0, []
    for s in sizes:
        out.append(seg)
        acc += s
        if acc >= limit:
            seg, acc = seg + 1, 0
    return out


def test_chunk_summary_matches_fold():
    rnd = random.Random(3)
    for _ in range(200):
        sizes = [rnd.choice([1, 2, 3, 50, 7, 120]) for _ in range(rnd.randint(1, 40))]
        limit = rnd.choice([5, 17, 64, 100, 400])
        import numpy as np
        steps = rotation._chunk_summary(np.array(sizes), limit)
        for carry in range(limit):
            pick = [s for s in steps if s[0] <= carry][-1]
            # reference: fold with an initial carry
            acc, rot = carry, 0
            for s in sizes:
                acc += s
                if acc >= limit:
                    rot, acc = rot + 1, 0
            exit_carry = carry + sum(sizes) if pick[1] == -1 else pick[1]
            assert (exit_carry, pick[2]) == (acc, rot), (sizes, limit, carry, steps)


def test_exact_rotation_over_chunks(spark):
    rnd = random.Random(11)
    rows, expected = [], {}
    for t in ("a", "b", "c"):
        seqs = sorted(rnd.sample(range(1, 5000), 700))
        sizes = [rnd.choice([1, 5, 40, 90, 300, 1500]) for _ in seqs]
        rows += [(t, q, s) for q, s in zip(seqs, sizes)]
        expected.update({(t, q): g for q, g in zip(seqs, _fold(sizes, 1000))})
    df = spark.createDataFrame(rows, "target string, seq long, nbytes long")
    for span in (64, 700, 100000):
        got = rotation.size_segments_exact(df, "target", "seq", "nbytes", 1000, chunk_span=span).collect()
        assert {(r.target, r.seq): r.segment for r in got} == expected, span


def _fold_interval(ts, interval):
    out, seg, t0 = [], 0, None
    for t in ts:
        if t0 is None:
            t0 = t
        elif t - t0 >= interval:
            seg, t0 = seg + 1, t
        out.append(seg)
    return out


def test_interval_summary_matches_fold():
    import numpy as np
    rnd = random.Random(5)
    for _ in range(200):
        ts = sorted(rnd.choice([0, 5, 10, 25, 70]) + i * rnd.choice([3, 10, 40]) for i in range(rnd.randint(1, 30)))
        interval = rnd.choice([10, 30, 100])
        steps = rotation._interval_summary(np.array(ts, dtype=np.int64), interval)
        for t0 in [ts[0] - d for d in (0, 2, 10, 29, 30, 99, 150)]:
            # reference: fold with an open file started at t0
            cur, rot = t0, 0
            for t in ts:
                if t - cur >= interval:
                    cur, rot = t, rot + 1
            hit = next((s for s in steps if t0 <= s[0]), None)
            got = (t0, 0) if hit is None else (hit[1], hit[2])
            assert got == (cur, rot), (ts, interval, t0, steps)
            seg = rotation._run_interval_chunk(np.array(ts, dtype=np.int64), interval, t0)
            assert int(seg[-1]) == rot


def test_exact_interval_rotation_over_chunks(spark):
    rnd = random.Random(9)
    rows, expected = [], {}
    for t in ("a", "b"):
        seqs = sorted(rnd.sample(range(1, 4000), 500))
        ts, acc = [], 0
        for _ in seqs:
            acc += rnd.choice([100_000, 500_000, 2_000_000, 7_000_000])
            ts.append(acc)
        rows += [(t, q, x) for q, x in zip(seqs, ts)]
        expected.update({(t, q): g for q, g in zip(seqs, _fold_interval(ts, 10_000_000))})
    df = spark.createDataFrame(rows, "target string, seq long, t long")
    for span in (50, 600, 100000):
        got = rotation.interval_segments_exact(df, "target", "seq", "t", 10_000_000, chunk_span=span).collect()
        assert {(r.target, r.seq): r.segment for r in got} == expected, span


def test_merge_tree_matches_fold(spark, monkeypatch):
    """Hundreds of small chunks, several levels, a NULL target, NULL and empty messages, times that repeat."""
    monkeypatch.setattr(rotation, "FAN", 3)
    rnd = random.Random(21)
    rows, expected = [], {}
    for t in ("a", None):
        seqs = list(range(1, 400))
        sizes = [rnd.choice([None, 0, 3, 20, 90, 400]) for _ in seqs]
        rows += [(t, q, s, 2 ** 60 + q) for q, s in zip(seqs, sizes)]
        expected.update({(t, q): g for q, g in zip(seqs, _fold([s or 0 for s in sizes], 250))})
    df = spark.createDataFrame(rows, "target string, seq long, nbytes long, wide long")
    for span in (2, 5, 1000):
        got = rotation.size_segments_exact(df, "target", "seq", "nbytes", 250, chunk_span=span).collect()
        assert {(r.target, r.seq): r.segment for r in got} == expected, span
        assert all(r.wide == 2 ** 60 + r.seq for r in got) and len(got) == len(rows)
    times = sorted(rnd.choice([0, 1, 1, 2, 9]) + i for i in range(300))
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)], "target string, seq long, t long")
    want = dict(enumerate(_fold_interval(times, 7)))
    got = rotation.interval_segments_exact(df, "target", "seq", "t", 7, chunk_span=4).collect()
    assert {r.seq: r.segment for r in got} == want
    assert rotation.size_segments_exact(df.limit(0), "target", "seq", "t", 7).count() == 0


def test_compose_matches_longer_run():
    import numpy as np
    rnd = random.Random(8)
    for _ in range(300):
        sizes = np.array([rnd.choice([0, 1, 2, 30, 7]) for _ in range(rnd.randint(3, 30))], dtype=np.int64)
        limit = rnd.choice([5, 17, 64, 100])
        a, b = sorted(rnd.sample(range(1, len(sizes)), 2)) if len(sizes) > 3 else (1, 2)
        parts = [rotation._size_step(p, limit) for p in (sizes[:a], sizes[a:b], sizes[b:])]
        whole = rotation._size_step(sizes, limit)
        left = rotation._compose(rotation._compose(parts[0], parts[1]), parts[2])
        right = rotation._compose(parts[0], rotation._compose(parts[1], parts[2]))
        x = np.arange(limit)
        for made in (left, right):
            assert all((p == q).all() for p, q in zip(rotation._apply(made, x), rotation._apply(whole, x)))
            assert len(made[0]) <= len(sizes) + 1
