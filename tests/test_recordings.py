"""The reader of recordings: what is asked is all that is read, and files that can't be decoded are told."""

import glob
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tacgrid import fixture as X
from tacgrid.sources import recordings as R
from tacgrid.sources import store

FOLDER = "/root/testdata/sf0.01"


def report(folder):
    return [json.load(open(f)) for f in glob.glob(f"{folder}/*.json")]


def total(lines, name):
    return sum(x[name] for x in lines)


@pytest.fixture(scope="module")
def library(spark):
    return X.recording_files(spark, FOLDER)


def read(spark, library, tmp_path, name):
    folder = str(tmp_path / name)
    return R.recordings(spark, library, X.RECORDED, report=f"file://{folder}"), folder


def test_only_asked_ticks_and_events_are_read(spark, library, tmp_path):
    rows, folder = read(spark, library, tmp_path, "all")
    n = rows.count()
    every = report(folder)
    assert n == total(every, "rows") == total(every, "rows_decoded") == spark.read.parquet(f"{FOLDER}/events.parquet").count()
    assert total(every, "blocks") == total(every, "blocks_read") > 50

    rows, folder = read(spark, library, tmp_path, "few")
    asked = rows.where(F.col("tick").isin(*R.HEADER_TICKS) & F.col("event").isin("error"))
    got = asked.select("event_id").collect()
    few = report(folder)
    assert len(got) == total(few, "rows") and total(few, "blocks_read") < total(few, "blocks") / 4 and total(few, "rows_decoded") < n / 4
    want = rows.where("event_id >= 0").collect()  # not pushed down: the same rows by Spark's own filter
    assert {r.event_id for r in got} == {r.event_id for r in want if r.tick in R.HEADER_TICKS and r.event == "error"}
    assert "PythonFilter" not in asked._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("where", ["tick = 40000", "tick > 190000", "tick >= 190000 AND tick < 194000", "tick <= 2000 AND event = 'view'", "recording IN (3, 5) AND event <> 'view'", "tick IN (NULL, 40000)", "tick > 5 AND tick < 3", "event = 'nothing'", "tick = 40000 OR event = 'view'"])
def test_filters_mean_what_sparks_own_do(spark, library, where):
    rows = R.recordings(spark, library, X.RECORDED)
    plain = spark.read.parquet(library)
    pick = lambda df: sorted(r.event_id for r in df.where(where).select("event_id").collect())
    assert pick(rows) == pick(plain)


def test_shares_of_large_files(spark, library, monkeypatch):
    monkeypatch.setattr(R, "TASK_BYTES", 20_000)
    reader = R.RecordingReader(spark.read.parquet(library).schema, {"path": library})
    parts = reader.partitions()
    assert len(parts) > 8 and max(of for p in parts for _, _, of in p.files) > 1
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == spark.read.parquet(library).count()


def test_bad_files_go_to_quarantine(spark, tmp_path):
    folder = tmp_path / "library"
    for k in range(3):
        spark.createDataFrame([(k, "e", 1)], "recording long, event string, tick long").coalesce(1).write.parquet(str(folder / f"good{k}"))
    (folder / "bad.parquet").write_bytes(b"no recording at all")
    (folder / "half.parquet").write_bytes(next((folder / "good0").glob("*.parquet")).read_bytes()[:200])
    path = f"file://{folder}"
    schema = "recording long, event string, tick long"
    with pytest.raises(Exception, match="bad.parquet|Parquet"):
        R.recordings(spark, path, schema).collect()
    assert sorted(r.recording for r in R.recordings(spark, path, schema, bad="skip").collect()) == [0, 1, 2]
    failed = R.bad_recordings(spark, path)
    assert sorted(r.path.rsplit("/", 1)[1] for r in failed.collect()) == ["bad.parquet", "half.parquet"]
    keyed = failed.withColumn("content_key", F.col("path"))
    known = spark.createDataFrame([(f"{path}/half.parquet",)], "content_key string")
    kept = store.quarantine(keyed, known).collect()
    assert [(r.status, r.path.rsplit("/", 1)[1]) for r in kept] == [("error", "bad.parquet")] and kept[0].error


class Lines:
    """A format of its own: a line of JSON for each block."""

    def __init__(self, fs, path):
        self.rows = [json.loads(x) for x in fs.open_input_file(path).readall().splitlines()]

    def blocks(self):
        return [R.Block(i, len(r), 1, {"tick": (min(r), max(r))}) for i, r in enumerate(self.rows)]

    def read(self, place, columns):
        import pyarrow as pa

        return pa.table({"recording": [place] * len(self.rows[place]), "event": ["e"] * len(self.rows[place]), "tick": self.rows[place]}).select(columns or ["tick"])


def test_other_decoders(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the class travels, as one of a notebook does
    (tmp_path / "a.dem").write_text("[1, 2, 3]\n[7, 8]")
    (tmp_path / "_b.dem").write_text("[1]")
    rows = R.recordings(spark, f"file://{tmp_path}", "tick int, recording long", decoder=Lines, suffix=".dem")
    assert sorted(map(tuple, rows.where("tick > 2").collect())) == [(3, 0), (7, 1), (8, 1)]
    named = R.recordings(spark, f"file://{tmp_path}", "tick int, recording long", decoder=Lines, files=json.dumps([f"file://{tmp_path}/_b.dem"]))
    assert named.collect() == [(1, 0)]
