"""The stateful track builder against the batch one: late samples, restarts, ends and idle videos."""

import random
import time

from aerolens.operators import tracking
from aerolens.streaming.tracks import INITIAL, stream_tracks

KIND = "video string, t double, dx double, dy double, blobs array<struct<x:int,y:int,w:int,h:int,score:double>>"


def _samples(videos, n, seed=1):
    rng = random.Random(seed)
    out = []
    for v in videos:
        for t in range(n):
            found = [(rng.randrange(0, 800, 40), rng.randrange(0, 400, 40), 4, 6, round(rng.random(), 3)) for _ in range(rng.choice([0, 1, 3]))]
            out.append((v, float(t), float(rng.choice([0, 2])), 0.0, found or None))
    return out


def _batch(spark, rows):
    return sorted((r["video"], r["t0"], r["t1"], r["t_best"], r["x"], r["score"]) for r in tracking.build_tracks(spark.createDataFrame(rows, KIND)).collect())


class _Stream:
    """A stream over a folder into a table, run until its input is used up, again and again from one checkpoint."""

    def __init__(self, spark, folder, **how):
        self.spark, self.folder, self.how = spark, folder, how
        (folder / "in").mkdir()

    def feed(self, *files):
        for rows in files:
            at = self.folder / f"new{time.time_ns()}"
            self.spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(at))
            for f in at.glob("*.parquet"):
                f.rename(self.folder / "in" / f"{time.time_ns()}.parquet")
        source = self.spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))
        q = stream_tracks(source, **self.how).writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "check")).trigger(availableNow=True).start()
        q.awaitTermination()

    def rows(self):
        return self.spark.read.parquet(str(self.folder / "out")).collect()

    def tracks(self):
        return sorted((r["video"], r["t0"], r["t1"], r["t_best"], r["x"], r["score"]) for r in self.rows())


def test_stream_with_late_samples_and_a_restart_equals_batch(spark, tmp_path):
    rows = _samples("ab", 24)
    order = sorted(rows, key=lambda r: r[1] + random.Random(hash((r[0], r[1])) % 97).uniform(0, 3))  # up to three seconds late
    s = _Stream(spark, tmp_path, late=3.0)
    s.feed(order[:20], order[20:30])
    s.feed(order[30:], order[10:14])  # the run goes on from its checkpoint; repeats are left out
    assert len(s.tracks()) < len(_batch(spark, rows))  # the last samples wait and tracks are open
    s.feed([("a", None, None, None, None), ("b", None, None, None, None)])
    assert s.tracks() == _batch(spark, rows)
    numbers = sorted((r["video"], r["track"]) for r in s.rows())
    assert numbers == [(v, k) for v in "ab" for k in range(sum(x == v for x, _ in numbers))]
    s.feed([("a", 1.0, 0.0, 0.0, [(5, 5, 2, 2, 1.0)]), ("a", None, None, None, None)])  # the same name later is another video
    assert len(s.tracks()) == len(_batch(spark, rows)) + 1


def test_stream_goes_on_from_given_tracks(spark, tmp_path):
    rows = _samples("v", 16, seed=4)
    t = tracking.Tracker()
    early = []
    for _, at, dx, dy, found in rows[:8]:
        early += t.feed(at, dx, dy, tracking.best_first([dict(zip("xywhs", b)) | {"score": b[4]} for b in found or []], tracking.TOP))
    given = [("v", 7.0, len(early), *s[:2], int(s[2]), *s[3:6], *map(int, s[6:10]), s[10]) for s in t.state()]
    s = _Stream(spark, tmp_path, initial=spark.createDataFrame(given, INITIAL))
    s.feed([*rows[4:], ("v", None, None, None, None)])  # four samples that are in the given state already
    whole = _batch(spark, rows)
    assert s.tracks() == sorted(x for x in whole if x not in [("v", k["t0"], k["t1"], k["t_best"], k["box"][0], k["score"]) for k in early])
    assert min(r["track"] for r in s.rows()) == len(early)


def test_idle_videos_close(spark, tmp_path):
    rows = _samples("i", 6, seed=2)
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(tmp_path / "in" / "first"))
    source = spark.readStream.schema(KIND).parquet(str(tmp_path / "in" / "*"))
    q = stream_tracks(source, idle_ms=1500).writeStream.format("memory").queryName("idle_tracks").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    want, until = len(_batch(spark, rows)), time.time() + 60
    while spark.sql("select * from idle_tracks").count() < want and time.time() < until:
        time.sleep(1)
    q.stop()
    assert spark.sql("select * from idle_tracks").count() == want > 0
