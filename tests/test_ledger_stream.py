import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from metaloom.streaming.ledger import append_told, ledger_stream

SCHEMA = "path string, collection string, hash string, status string, at timestamp"
START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def told(spark, folder, batches, **options):
    """What a stream tells that gets these batches of rows, one file each, in order."""
    source = folder / "in"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source / f"b{n}"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source / "*"))
        append_told(ledger_stream(stream, **options), str(folder / "out"), str(folder / "cp")).awaitTermination(120)
    return spark.read.parquet(str(folder / "out"))


def standing(rows):
    last = rows.where("event = 'status'").groupBy("path", "collection").agg(F.max_by(F.struct("hash", "status", "retry_count", "at"), "batch").alias("s"))
    return {(r.path, r.collection): (r.s.hash, r.s.status, r.s.retry_count, r.s.at) for r in last.collect()}


def plainly(rows):
    """The same from all rows at once."""
    out = {}
    sound = sorted({r for r in rows if None not in (r[0], r[1], r[3], r[4])}, key=lambda r: (r[0], r[1]))
    for key, mine in itertools.groupby(sound, key=lambda r: (r[0], r[1])):
        mine = list(mine)
        done = max(((r[4], r[2] or "", r[2]) for r in mine if r[3] != "failed"), default=None, key=lambda x: x[:2])
        bad = [r for r in mine if r[3] == "failed" and (done is None or r[4] > done[0])]
        if bad:
            last = max(bad, key=lambda r: (r[4], r[2] or ""))
            out[key] = (last[2], "failed", len({r[4] for r in bad}), last[4])
        else:
            out[key] = (done[2], "indexed", 0, done[0])
    return out


def test_any_order_and_repeated_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("abcdef"), rng.choice(["code", "help"]), rng.choice([None, "", "x", "y"]), rng.choice(["failed", "failed", "indexed", "skipped"]), at(rng.randrange(40))) for _ in range(120)]
    rows += rows[:20] + [(None, "code", "x", "failed", at(1)), ("a", None, "x", "failed", at(1)), ("a", "code", "x", None, at(1)), ("a", "code", "x", "failed", None)]
    rng.shuffle(rows)
    found = told(spark, tmp_path, [rows[:70], rows[70:]], late="2 hours")
    assert standing(found) == plainly(rows) and found.where("event = 'retry'").count() == 0


def test_timers(spark, tmp_path):
    first = [("a", "code", "x", "failed", at(0)), ("b", "code", "x", "indexed", at(0)), *[("c", "code", "x", "failed", at(n)) for n in range(3)]]
    later = [("z", "code", "x", "indexed", at(200))]
    again = [("a", "code", "x", "failed", at(210)), ("z", "code", "x", "indexed", at(600))]
    late = [("b", "code", "x", "failed", at(1)), ("z", "code", "x", "indexed", at(900))]
    rows = told(spark, tmp_path, [first, later, again, late], late="1 hour", retry_after="10 minutes")
    retries = rows.where("event = 'retry'").orderBy("batch").collect()
    # a is told once for each of its failures; c failed too often; b was done, and what came too late about it is left out
    assert [(r.path, r.retry_count, r.at) for r in retries] == [("a", 1, at(0)), ("a", 2, at(210))]
    assert standing(rows)["b", "code"][1:3] == ("indexed", 0)


def test_forgotten_and_empty(spark, tmp_path):
    rows = told(spark, tmp_path, [[("a", "code", "x", "failed", at(0))], [("z", "code", "x", "indexed", at(500))], [("z", "code", "x", "indexed", at(501))], [], [("a", "code", "y", "failed", at(501))]], late="1 minute", retry_after="10 minutes", forget="2 hours")
    last = standing(rows)["a", "code"]
    assert last == ("y", "failed", 1, at(501))  # the failure before was dropped with its state
