"""Queues of items, commits and archives: what happens when something fails, comes twice or comes at once."""

import os
import random
import struct
import zipfile
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from graphloom.sources import archives, builds, readers
from graphloom.sources.commits import Commit, CommitLog, put_if_absent, read_text
from graphloom.streaming import queue


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def test_one_of_many_creates_a_file(spark, folder):
    with ThreadPoolExecutor(8) as pool:
        for n in range(3):
            won = list(pool.map(lambda i: put_if_absent(spark, f"{folder}/a/{n}", f"writer {i}"), range(8)))
            assert sum(won) == 1 and read_text(spark, f"{folder}/a/{n}") == f"writer {won.index(True)}"
    assert sorted(os.listdir(f"{folder}/a")) == ["0", "1", "2"]


def test_commits_are_in_one_order(spark, folder):
    """Writers with logs of their own: no number twice, none left out, and each rule sees all that came before."""
    limited = lambda log: len([c for c in log if c.action == "x"]) < 12

    def write(i):
        log = CommitLog(spark, folder)
        return sum(log.append(Commit("x", f"{i}.{k}"), limited) for k in range(4))

    with ThreadPoolExecutor(6) as pool:
        assert sum(pool.map(write, range(6))) == 12
    log = CommitLog(spark, folder)
    assert [c.number for c in log.commits()] == list(range(12)) and len({c.name for c in log.commits()}) == 12
    assert log.table().count() == 12


def test_one_of_two_publishers_wins(spark, folder):
    def publish(v):
        try:
            builds.Builds(spark, folder).publish("build", frame(spark, [(1, v)]))
            return v
        except builds.BuildError:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [v for v in pool.map(publish, "abcd") if v]
    assert len(won) == 1 and [r.v for r in builds.Builds(spark, folder).read().collect()] == won


def test_failed_and_abandoned_builds(spark, folder, monkeypatch):
    store = builds.Builds(spark, folder)
    bad = frame(spark, [(1, "a")]).withColumn("v", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.publish("b", {"good": frame(spark, [(1, "a")]), "bad": bad})
    assert [(r.build_id, r.status) for r in store.status().collect()] == [("b", "failed")]
    with pytest.raises(builds.BuildError):
        store.read("b", "good")  # not one of the two tables appears
    store.publish("b", frame(spark, [(2, "b")]))  # the name of a failed build is free
    other = builds.Builds(spark, folder)
    real = other.log.staged

    def interrupted(tables):
        out = real(tables)
        store.abandon("slow")  # another one gave this writer up meanwhile
        return out

    monkeypatch.setattr(other.log, "staged", interrupted)
    with pytest.raises(builds.BuildError, match="abandoned"):
        other.publish("slow", frame(spark, [(3, "c")]))
    assert store.active() == "b" and store.only() == "b"
    with pytest.raises(builds.BuildError):
        store.abandon("b")


def test_batches_and_snapshots(spark, folder):
    log, rows = CommitLog(spark, folder), frame(spark, [(1, "a"), (2, None), (2, None)])
    assert log.publish_batch("r", 0, {"t": rows}) and not log.publish_batch("r", 0, {"t": rows.orderBy(F.desc("k")).repartition(2)})
    for other in (rows.distinct(), frame(spark, [(1, "b"), (2, None), (2, None)]), rows.withColumn("k", F.col("k").cast("int"))):
        with pytest.raises(builds.BuildError):
            CommitLog(spark, folder).publish_batch("r", 0, {"t": other})
    assert log.publish_batch("r", 1, {"t": rows.limit(1)}) and log.publish_batch("other", 0, {"t": rows.limit(1)})
    assert sorted((r.k, r.batch) for r in log.batches("t", "r").collect()) == [(1, 0), (1, 1), (2, 0), (2, 0)]
    assert len([f for f in os.listdir(f"{folder}/data")]) == 3  # refused and repeated payloads leave nothing
    first = log.replace_all("load", {"a": rows, "b": rows.limit(1)})
    bad = rows.withColumn("v", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        log.replace_all("load", {"a": rows.limit(0), "b": bad})
    assert {k: t.count() for k, t in log.snapshot().items()} == {"a": 3, "b": 1}
    second = log.replace_all("load", {"a": rows.limit(0)}, first)
    with pytest.raises(builds.BuildError):
        log.replace_all("load", {"a": rows}, first)
    assert {k: t.count() for k, t in log.snapshot().items()} == {"a": 0} and log.snapshot(second - 1).keys() == {"a", "b"}


def work(payload, attempt):
    n = int(payload[1:])
    if n % 7 == 3:
        raise ValueError("never")
    if n % 5 == 1 and attempt < 3:
        raise RuntimeError(f"not at {attempt}")
    return payload.upper()


def items(spark, folder, rows):
    spark.createDataFrame(rows, "id long, payload string").write.mode("append").parquet(f"{folder}/in")
    return lambda: spark.readStream.schema("id long, payload string").parquet(f"{folder}/in")


def test_items_are_retried_alone(spark, folder):
    def want(n):
        return ("parked", 3) if n % 7 == 3 else ("verified", 3 if n % 5 == 1 else 1)

    q = queue.ItemQueue(spark, f"{folder}/q", work)
    stream = items(spark, folder, [(n, f"p{n}") for n in range(30)])
    q.start(stream()).awaitTermination()
    tried = {r.id: r.status for r in q.attempts().collect()}
    assert len(tried) == 30 and {int(k) for k, s in tried.items() if s == "failed"} == {n for n in range(30) if want(n)[1] == 3}
    again = queue.ItemQueue(spark, f"{folder}/q", work)  # another process goes on from the checkpoint
    again.drain(stream)
    assert {int(r.id): (r.status, r.attempts) for r in again.status().collect()} == {n: want(n) for n in range(30)}
    assert {int(r.id): (r.status, r.attempts) for r in again.state().collect()} == {n: want(n) for n in range(30)}
    per_batch = {(r.batch, r.n) for r in again.attempts().groupBy("batch").agg(F.count("*").alias("n")).collect()}
    failing = sum(want(n)[1] == 3 for n in range(30))
    assert per_batch == {(0, 30), (1, failing), (2, failing)}  # later passes read only what failed
    assert {r.error for r in again.status().where("status = 'parked'").collect()} == {"ValueError: never"}
    # the same items again do nothing, a known one with another payload is refused, new ones are worked on
    again.drain(items(spark, folder, [(1, "p1"), (2, "p99"), (40, "p40")]))
    assert [r.id for r in again.refused().collect()] == ["2"]
    assert {r.id: r.result for r in again.results().where("id IN ('1', '2', '40')").collect()} == {"1": "P1", "2": "P2", "40": "P40"}


def test_queue_after_a_crash(spark, folder, monkeypatch):
    """The process dies after the rows were published and before the checkpoint knows it: nothing is counted twice."""
    q = queue.ItemQueue(spark, f"{folder}/q", work)
    stream, real, calls = items(spark, folder, [(n, f"p{n}") for n in range(12)]), q.log.publish_batch, []

    def dies(run, batch, tables):
        out = real(run, batch, tables)
        calls.append(batch)
        if len(calls) == 1:
            raise RuntimeError("died")
        return out

    monkeypatch.setattr(q.log, "publish_batch", dies)
    with pytest.raises(StreamingQueryException):
        q.start(stream()).awaitTermination()
    q.drain(stream)
    assert calls[:2] == [0, 0]
    rows = q.attempts().groupBy("id", "attempts").agg(F.count("*").alias("n")).where("n > 1")
    assert rows.isEmpty() and q.status().count() == 12 and q.status().where("status = 'failed'").isEmpty()


def test_runs_are_guarded_at_once(spark, folder):
    def claim(i):
        try:
            queue.guarded(spark, folder, "run", f"s{i % 2}")
            return i % 2
        except queue.SignatureError:
            return None

    with ThreadPoolExecutor(8) as pool:
        assert len({x for x in pool.map(claim, range(8)) if x is not None}) == 1


def sample(path, n, mode="w", seed=0):
    rng, out = random.Random(seed), {}
    with zipfile.ZipFile(path, mode) as z:
        for i in range(n):
            name = rng.choice([f"a/{i}.txt", f"b/é{i}.TXT", f"c/{i}.jpg", f"d{i}/"])
            body = b"" if name.endswith("/") else bytes(rng.choices(b"abcdefgh \n", k=rng.randrange(0, 400)))
            z.writestr(name, body, rng.choice([zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA]))
            out[name] = body
    return out


def test_archives_in_spans(spark, folder):
    want = sample(f"{folder}/x.zip", 300)
    sample(f"{folder}/sub.zip", 20, seed=1)
    with zipfile.ZipFile(f"{folder}/none.zip", "w"):
        pass
    rows = archives.members(spark, folder, content=".", span_bytes=5000)
    assert rows.rdd.getNumPartitions() > 8
    got = [r for r in rows.collect() if r.archive.endswith("/x.zip")]
    assert {r.member: bytes(r.content) if r.content is not None else b"" for r in got} == want and all(r.fault is None for r in got)
    columns = ["member", "size", "compressed_size", "crc", "compression", "header_offset", "kind"]
    whole = readers.archive_members(spark, folder)
    assert sorted(map(tuple, rows.select(*columns).collect())) == sorted(map(tuple, whole.select(*columns).collect()))
    ends = {(r.member, r.header_offset): r.entry_end for r in whole.where("entry_end IS NOT NULL").collect()}
    assert ends.items() <= {(r.member, r.header_offset): r.entry_end for r in rows.collect()}.items()
    texts = {r.member for r in archives.members(spark, folder).where("content IS NOT NULL").collect()}
    assert {m for m in want if m.lower().endswith(".txt")} <= texts and not any(m.endswith(".jpg") for m in texts)


def test_archive_behind_five_gigabytes(spark, folder):
    """A sparse file of 5 GB with an archive at its end: offsets of 64 bits, and only the spans are read."""
    with open(f"{folder}/big.zip", "wb") as f:
        f.truncate(5 << 30)
    want = sample(f"{folder}/big.zip", 50, "a")
    rows = archives.members(spark, folder, content=".", span_bytes=4000).collect()
    assert {r.member: bytes(r.content or b"") for r in rows} == want and min(r.header_offset for r in rows) >= 5 << 30


def test_archive_whose_numbers_fit_the_short_record(folder):
    """From 2 GB on archivers write the record of 64 bits, though the short one still holds the numbers."""
    with open(f"{folder}/big.zip", "wb") as f:
        f.truncate((2 << 30) + 5)
    sample(f"{folder}/big.zip", 20, "a")
    found = archives.spans(f"{folder}/big.zip", 0, 100_000)
    with open(f"{folder}/big.zip", "rb") as f, zipfile.ZipFile(f) as z:
        f.seek(found[0].parts[0][0])
        assert f.read(4) == b"PK\x01\x02" and z.start_dir == min(a for s in found for a, _ in s.parts)


def test_many_spans_are_few_tasks(spark, folder, monkeypatch):
    """The driver holds something of each task, so spans of any size are dealt to a bounded number of them."""
    want = sample(f"{folder}/x.zip", 2500)
    rows = archives.members(spark, folder, content=".", span_bytes=30)
    n = len(archives.spans(f"{folder}/x.zip", archives.MAX_GAP, 30))
    assert rows.rdd.getNumPartitions() == 2048 < n
    assert {r.member: bytes(r.content or b"") for r in rows.coalesce(4).collect()} == want


def test_damaged_archives(spark, folder):
    sample(f"{folder}/x.zip", 40)
    blob = bytearray(open(f"{folder}/x.zip", "rb").read())
    rows = {r.member: r for r in archives.members(spark, folder, content=".").collect()}
    hit = next(r for r in rows.values() if r.compression == 0 and r.size > 20)
    blob[hit.entry_end - 3] ^= 1
    cut = next(r for r in rows.values() if r.compression == 8 and r.size > 50)
    blob[cut.header_offset] = 0
    open(f"{folder}/x.zip", "wb").write(blob)
    faults = {r.member: (r.fault, r.content) for r in archives.members(spark, folder, content=".").where("fault IS NOT NULL").collect()}
    assert faults == {hit.member: ("checksum", None), cut.member: ("BadZipFile", None)}
    os.makedirs(f"{folder}/no")
    open(f"{folder}/no/y.zip", "wb").write(b"no archive")
    with pytest.raises(Exception, match="no end record"):
        archives.members(spark, f"{folder}/no").collect()
    small = archives.members(spark, f"{folder}/x.zip", content=".")
    assert small.count() == 40
    with zipfile.ZipFile(f"{folder}/twice.zip", "w") as z, pytest.warns(UserWarning):
        z.writestr("a.txt", "1")
        z.writestr("a.txt", "2")
    assert [r.member for r in archives.repeated_members(archives.members(spark, f"{folder}/twice.zip")).collect()] == ["a.txt"]


def test_directories_in_any_order(folder):
    """Members lie in another order than the directory tells of them; two that overlap are an error."""
    path = f"{folder}/x.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(30):
            z.writestr(f"{i}.txt", "x" * i)
        z.filelist.reverse()
    found = archives.spans(path, 0, 200)
    with open(path, "rb") as f:
        blob = f.read()
    names = [[e[2] for a, b in s.parts for e in archives.entries(blob[a:b])] for s in found]
    assert [n for part in names for n in part] == [f"{i}.txt" for i in range(30)] and len(found) > 5
    with zipfile.ZipFile(path) as z:
        start = z.start_dir
    for at in range(start, len(blob) - 46):
        if blob[at : at + 4] == b"PK\x01\x02":
            blob = blob[: at + 42] + struct.pack("<I", 0) + blob[at + 46 :]
    open(path, "wb").write(blob)
    with pytest.raises(archives.ArchiveError, match="overlap"):
        archives.spans(path, 0, 200)


def plain_cut(first, last, apart, max_gap, max_span):
    out, begin = [], None
    for i in range(len(first)):
        if i and not apart[i] and first[i] - last[i - 1] - 1 <= max_gap and last[i] - begin + 1 <= max_span:
            out.append(out[-1])
        else:
            begin = first[i]
            out.append(out[-1] + 1 if out else 0)
    return out


def test_spans_are_cut_at_members(spark):
    rng = random.Random(4)
    rows = []
    for n in range(60):
        first, last, at = [], [], 0
        for _ in range(rng.randrange(1, 40)):
            at += rng.choice([0, 0, 3, 50])
            first.append(at)
            at += rng.randrange(1, 60)
            last.append(at - 1)
        apart = [rng.random() < 0.2 for _ in first]
        got = archives.cut(np.array(first), np.array(last), np.array(apart), 10, 100).tolist()
        assert got == plain_cut(first, last, apart, 10, 100)
        kinds = [rng.choice(["text", "text", "text", "meta", "image"]) for _ in first]
        rows += [(str(n), a, b, k) for a, b, k in zip(first, last, kinds)]
    df = spark.createDataFrame(rows, "archive string, header_offset long, entry_end long, kind string")
    got = {(r.archive, r.first, r.last, r.n_members) for r in archives.read_spans(df, F.col("kind") == "text", F.col("kind") == "meta", 10, 100).collect()}
    want = set()
    for n in {r[0] for r in rows}:
        mine, span, blocked = [r for r in rows if r[0] == n], None, False
        for _, a, b, k in mine:
            if k != "text":
                blocked = blocked or k != "meta"
                continue
            if span and not blocked and a - span[1] - 1 <= 10 and b - span[0] + 1 <= 100:
                span = (span[0], b, span[2] + 1)
            else:
                if span:
                    want.add((n, *span))
                span = (a, b, 1)
            blocked = False
        if span:
            want.add((n, *span))
    assert got == want
