"""Retention that deletes: the newest segments stay, a second run does nothing, a stopped run is finished."""

import pytest

from eventloom.operators import retire as R


def _sink(root, segments):
    for target, numbers in segments.items():
        for n in numbers:
            folder = root / f"target={target}" / f"segment={n}"
            folder.mkdir(parents=True)
            for part in range(2):
                (folder / f"part-{part}.txt").write_text(f"{target} {n}\n")


def _left(root):
    return {t.name.partition("=")[2]: sorted(int(s.name.partition("=")[2]) for s in t.iterdir()) for t in root.iterdir() if t.name.startswith("target=")}


@pytest.fixture
def folders(tmp_path):
    sink = tmp_path / "sink"
    _sink(sink, {"MIDDLE EAST": range(20), "a%3Ab": [5, 100, 9, 7], "one": [3]})
    (sink / "notes").mkdir()
    (sink / "notes" / "keep.txt").write_text("x")
    (sink / "target=one" / "segment=old").mkdir()
    (sink / "target=one" / "segment=old" / "part").write_text("x")
    return sink, str(tmp_path / "journal")


def test_segments_are_listed(spark, folders):
    rows = {(r.target, r.segment): (r.files, r.bytes) for r in R.list_segments(spark, str(folders[0])).collect()}
    assert len(rows) == 25 and rows["a%3Ab", 100] == (2, 20)


def test_second_run_deletes_nothing(spark, folders):
    sink, journal = folders
    first = R.retire(spark, str(sink), journal, 4).collect()
    assert {(r.target, r.segment) for r in first} == {("MIDDLE EAST", n) for n in range(17)} | {("a%3Ab", 5)}
    assert {r.outcome for r in first} == {"deleted"}
    (sink / "target=one" / "segment=old" / "part").unlink()
    (sink / "target=one" / "segment=old").rmdir()
    want = {"MIDDLE EAST": [17, 18, 19], "a%3Ab": [7, 9, 100], "one": [3]}
    assert _left(sink) == want and (sink / "notes" / "keep.txt").exists()
    assert R.retire(spark, str(sink), journal, 4).collect() == [] and _left(sink) == want


def test_stopped_run_is_finished(spark, folders, monkeypatch):
    sink, journal = folders
    run = R.plan_retirement(spark, str(sink), journal, 4)
    gone = sink / "target=MIDDLE EAST" / "segment=0"                # the job stopped after its first folder
    for f in gone.iterdir():
        f.unlink()
    gone.rmdir()
    assert R.pending(spark, journal).count() == 18
    new = R.retire(spark, str(sink), journal, 4).collect()
    assert new == [] and R.pending(spark, journal).count() == 0
    done = {r.segment: r.outcome for r in spark.read.parquet(f"{journal}/done").filter(f"run = '{run}' and target = 'MIDDLE EAST'").collect()}
    assert done == {0: "absent", **{n: "deleted" for n in range(1, 17)}}


def test_plan_takes_no_open_row_again(spark, folders):
    sink, journal = folders
    R.plan_retirement(spark, str(sink), journal, 4)
    R.plan_retirement(spark, str(sink), journal, 3)
    rows = R.pending(spark, journal).collect()
    assert len(rows) == len({r.path for r in rows}) == 20
