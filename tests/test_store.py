"""One commit over all tables: what is interrupted, replaced, removed, or written by two at once."""

import pytest
from pyspark.sql import functions as F

from tacgrid.sources import store


def tables(spark, ids, mark):
    rows = lambda n: spark.createDataFrame([(i, k, mark) for i in ids for k in range(n)], "recording_id long, k int, mark string")
    return {"snapshots": rows(3), "rounds": rows(2), "recordings": rows(1)}


def seen(library, version=None):
    return {t: sorted((r.recording_id, r.mark) for r in library.read(t, version).collect()) for t in ("snapshots", "rounds", "recordings")}


def whole(*marks):
    return {t: sorted((i, m) for i, m in marks for _ in range(n)) for t, n in (("snapshots", 3), ("rounds", 2), ("recordings", 1))}


def test_a_recording_is_replaced_whole(spark, tmp_path):
    library = store.Library(spark, f"file://{tmp_path}/library")
    assert library.version() == 0 and not library.has("rounds") and not library.has("geo")
    library.write_all(tables(spark, [1, 2, 3], "old"))
    before = library.read("rounds")
    library.write_all(tables(spark, [2], "new"))
    assert seen(library) == whole((1, "old"), (2, "new"), (3, "old")) and library.version() == 2
    assert seen(library, 1) == whole((1, "old"), (2, "old"), (3, "old"))
    assert sorted(r.mark for r in before.collect()) == ["old"] * 6  # a frame stays with its commit
    library.write_all({"recordings": tables(spark, [3], "short")["recordings"]})
    assert seen(library) == {"snapshots": whole((1, "old"), (2, "new"))["snapshots"], "rounds": whole((1, "old"), (2, "new"))["rounds"], "recordings": [(1, "old"), (2, "new"), (3, "short")]}
    library.remove(1, 3)
    assert seen(library) == whole((2, "new"))
    size = library.size()
    assert library.vacuum() == 3 + 1 and library.size() < size and seen(library) == whole((2, "new"))
    library.write("rounds", tables(spark, [2], "again")["rounds"])
    assert seen(library)["rounds"] == [(2, "again")] * 2 and seen(library)["snapshots"] == [(2, "new")] * 3
    library.clear()
    assert not any((tmp_path / "library" / "rounds").glob("commit=*/recording_id=*")) and library.version() == 6


@pytest.mark.parametrize("stop", ["between tables", "before the manifest", "before it counts", "while it is named"])
def test_an_interrupted_write_changes_nothing(spark, tmp_path, monkeypatch, stop):
    library = store.Library(spark, f"file://{tmp_path}/library")
    library.write_all(tables(spark, [1, 2], "old"))
    broken = store.Library(spark, library.root)
    new = tables(spark, [2, 3], "new")
    fail = F.raise_error(F.lit("killed"))
    if stop == "between tables":
        new["rounds"] = new["rounds"].withColumn("mark", F.when(F.col("k") == 1, fail).otherwise(F.col("mark")))
    elif stop == "before the manifest":
        monkeypatch.setattr(broken, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    elif stop == "before it counts":
        monkeypatch.setattr(broken, "_pointers", lambda: (_ for _ in ()).throw(RuntimeError("killed")) if (tmp_path / "library" / "_manifest").exists() and len(list((tmp_path / "library" / "_manifest").iterdir())) > 1 else store.Library._pointers(broken))
    else:
        monkeypatch.setattr(broken, "_commit", lambda base, rows: (tmp_path / "library" / "_current" / f"{base + 1:012d}").touch())
    if stop == "while it is named":
        broken.write_all(new)  # its file is there, and empty
    else:
        with pytest.raises(Exception, match="killed"):
            broken.write_all(new)
    assert seen(library) == whole((1, "old"), (2, "old")) and library.version() == 1
    library.write_all(tables(spark, [2, 3], "new"))
    assert seen(library) == whole((1, "old"), (2, "new"), (3, "new"))


def test_of_two_writers_one_is_refused(spark, tmp_path, monkeypatch):
    library = store.Library(spark, f"file://{tmp_path}/library")
    library.write_all(tables(spark, [1], "old"))
    other = store.Library(spark, library.root)
    plain = other._commit

    def late(base, rows):
        library.write_all(tables(spark, [2], "first"))
        return plain(base, rows)

    monkeypatch.setattr(other, "_commit", late)
    with pytest.raises(store.Conflict):
        other.write_all(tables(spark, [1], "second"))
    assert seen(library) == whole((1, "old"), (2, "first"))


def test_rows_without_a_recording_and_no_rows(spark, tmp_path):
    library = store.Library(spark, f"file://{tmp_path}/library")
    rows = spark.createDataFrame([(None, 1, "x"), (4, 1, "y")], "recording_id long, k int, mark string")
    library.write_all({"rounds": rows, "snapshots": rows.limit(0)})
    assert [r.recording_id for r in library.read("rounds").collect()] == [4]
    with pytest.raises(ValueError):
        library.write_all({"other": rows})
