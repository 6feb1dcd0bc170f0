"""The watcher after crashes, its log of arrivals, and the sink of placed parts."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from ampliflow.operators import outputs
from ampliflow.streaming import watch


def facts(spark, n, hot=0.9, first=0):
    r = random.Random(n + first)
    rows = []
    for k in range(first, first + n):
        sample = "unknown" if r.random() < hot else f"S{k % 7}"
        kind = "unknown" if sample == "unknown" else "full"
        rows.append((k, 0, f"r{k}", "0,0,0,0", sample, kind, "P", "F-R", "F", "R", "ACGT" * (k % 50), "IIII" * (k % 50), kind == "full", f"{kind}/P/F-R/{sample}"))
    ddl = "read_id long, cand_ord int, seq_id string, distance_code string, sample string, match_type string, pool string, primer_pair string, p1_name string, p2_name string, seq string, qual string, is_full boolean, path string"
    return spark.createDataFrame(rows, ddl)


def texts(folder):
    out = {}
    for d, names, files in os.walk(folder):
        names[:] = [n for n in names if not n.startswith(".")]
        out |= {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for f in files if f.endswith("fastq")}
    return out


def expected(*frames):
    out = {}
    for df in frames:
        for r in outputs.rolled_up(df).orderBy("read_id").withColumn("text", outputs.record(df)).collect():
            out[f"{r['path']}.fastq"] = out.get(f"{r['path']}.fastq", b"") + r["text"].encode()
    return out


def test_a_hot_file_is_put_together_by_many_tasks(spark, tmp_path, monkeypatch):
    df, folder = facts(spark, 3000).repartition(6), str(tmp_path / "o")
    calls = []
    finish = outputs._finish

    def spy(spark_, folder_, stage):
        placed = spark_.read.parquet(f"file://{stage}/_placed")
        calls.append(placed.groupBy("path").agg(F.count("*").alias("parts"), F.max("bytes").alias("most"), F.sum("bytes").alias("all")).orderBy(F.desc("all")).first())
        return finish(spark_, folder_, stage)

    monkeypatch.setattr(outputs, "_finish", spy)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with a large file
    try:
        assert outputs.write_files(df, folder) == len(expected(df))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert texts(folder) == expected(df)
    assert calls[0]["path"].startswith("unknown") and calls[0]["parts"] >= 3 and calls[0]["most"] < 0.6 * calls[0]["all"]
    # What is appended goes behind what is there, which keeps its file.
    inode = os.stat(f"{folder}/unknown/P/F-R/unknown.fastq").st_ino
    more = facts(spark, 200, first=3000)
    outputs.write_files(more, folder)
    assert texts(folder) == expected(df, more) and os.stat(f"{folder}/unknown/P/F-R/unknown.fastq").st_ino == inode
    assert not [n for n in os.listdir(folder) if n.startswith(".parts")]


def test_batches_and_broken_runs(spark, tmp_path, monkeypatch):
    one, two, folder = facts(spark, 300), facts(spark, 250, first=300), str(tmp_path / "o")
    assert outputs.write_files(one, folder, batch="a") > 0
    assert outputs.write_files(one, folder, batch="a") == 0 and outputs.is_written(folder, "a") and not outputs.is_written(folder, "b")
    before = texts(folder)

    # A run that breaks off before its places are fixed leaves nothing.
    mark = outputs._mark
    monkeypatch.setattr(outputs, "_mark", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        outputs.write_files(two, folder, batch="b")
    monkeypatch.setattr(outputs, "_mark", mark)
    assert outputs.recover(spark, folder) == 0 and texts(folder) == before

    # One that breaks off later is ended by the next, with parts copied before, in part or not at all.
    finish = outputs._finish

    def broken(spark_, folder_, stage):
        for r in spark_.read.parquet(f"file://{stage}/_placed").collect()[::2]:
            target = outputs._target(folder_, stage, r["path"], r["held"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "r+b" if os.path.exists(target) else "wb") as f, open(f"{r['own']}/{r['path']}", "rb") as part:
                f.seek(r["at"])
                f.write(part.read()[: r["bytes"] // 2])
        raise OSError("killed")

    monkeypatch.setattr(outputs, "_finish", broken)
    with pytest.raises(OSError, match="killed"):
        outputs.write_files(two, folder, batch="b")
    monkeypatch.setattr(outputs, "_finish", finish)
    assert outputs.write_files(two, folder, batch="b") == 0  # recovered, so it is there
    assert texts(folder) == expected(one, two)

    # Or after its commit, before its stage is gone.
    rmtree = outputs.shutil.rmtree
    monkeypatch.setattr(outputs.shutil, "rmtree", lambda *a, **k: None)
    three = facts(spark, 50, first=600)
    outputs.write_files(three, folder, batch="c")
    monkeypatch.setattr(outputs.shutil, "rmtree", rmtree)
    assert outputs.recover(spark, folder) >= 1 and texts(folder) == expected(one, two, three)


def test_log_of_arrivals(tmp_path):
    log = watch.ArrivalLog(str(tmp_path / "log"))
    files = [(f"/in/{n}.fastq", n) for n in range(1000)]
    for k in range(0, 1000, 7):
        log.append(files[k : k + 7])
        assert len(log.segments()) <= 11
    assert len(log) == 1000 and log.read() == files and log.read(990, 993) == files[990:993] and log.read(5, 5) == []
    # What a crash leaves between a merged segment and its parts' removal.
    (tmp_path / "log/0-0").write_text(json.dumps(files[0]) + "\n")
    assert watch.ArrivalLog(str(tmp_path / "log")).read() == files


def test_offsets_stay_small(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(1000):
        (folder / f"{n:04}.fastq").write_text("")
    options = {"path": str(folder), "log": str(tmp_path / "log"), "settleTime": "0", "maxFilesPerTrigger": "100"}
    reader, sizes, start, got = watch.SettledReader(options), [], {"place": 0}, []
    for n in range(12):
        if n == 5:
            reader = watch.SettledReader(options)  # a restart
        end = reader.latestOffset()
        got += [f for p in reader.partitions(start, end) for f in reader.read(p)]
        sizes.append(len(json.dumps(end)))
        start = end
    assert max(sizes) <= len('{"place": 1000}') and [p.rsplit("/", 1)[1] for p, _, _ in got] == [f"{n:04}.fastq" for n in range(1000)] and [x for _, _, x in got] == list(range(1000))


class Crash(BaseException):
    pass


def test_kill_and_restart(spark, tmp_path, monkeypatch):
    """A crash after the sink's commit, before the status: the batch runs again, and neither files nor statuses double."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "old.fastq").write_text("")
    runs, frames = [], {}

    def process(reads, path, batch):
        runs.append((os.path.basename(path), batch))
        frames.setdefault(batch, facts(spark, 40, first=100 * len(frames)))
        outputs.write_files(frames[batch], out, batch=batch)

    def begin(**more):
        return watch.watch(spark, str(folder), process, str(tmp_path / "c"), str(tmp_path / "s"), settle_time=0.2, **more)

    record = watch._record

    def broken(spark_, status, name, rows):
        if name.startswith("arrival"):
            raise RuntimeError("killed")
        record(spark_, status, name, rows)

    monkeypatch.setattr(watch, "_record", broken)
    query = begin()
    (folder / "one.fastq").write_text("@a\nA\n+\nI\n")
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination(120)
    monkeypatch.setattr(watch, "_record", record)
    (folder / "while-down.fastq").write_text("")
    query = begin(stop_after=2)
    (folder / "two.fastq").write_text("@b\nC\n+\nI\n")
    query.awaitTermination(120)
    assert [n for n, _ in runs] == ["one.fastq", "one.fastq", "two.fastq"] and runs[0] == runs[1]
    assert texts(out) == expected(*frames.values())
    # A third start changes no status.
    query = begin()
    query.stop()
    status = {os.path.basename(r["path"]): r["status"] for r in watch.status_table(spark, str(tmp_path / "s")).collect()}
    assert status == {"old.fastq": "ignored", "one.fastq": "success", "while-down.fastq": "ignored", "two.fastq": "success"}
