"""Tracks from detections: greedy nearest match in score order, with a time to live counted in samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pixels within which a blob continues a track, samples that it may miss, and blobs of a sample.
REACH, MISSES, TOP = 60.0, 3, 25
OUT = "video string, track int, t_best double, t0 double, t1 double, x int, y int, w int, h int, score double"
_CLOSED = OUT.replace("track int", "closed long")


class Tracker:
    """The state of one video. feed() takes one sample and returns the tracks that it closes.

    The centre of a box is its corner plus half its size, rounded down.
    """

    def __init__(self, reach: float = REACH, misses: int = MISSES):
        self.reach, self.misses = reach, misses
        self.at = np.zeros((0, 2))
        self.open: list[dict] = []

    def feed(self, t: float, dx: float, dy: float, found: list[tuple]) -> list[dict]:
        """found: (x, y, w, h, score), best first. A blob may continue a track that this very sample began."""
        n = len(self.open)
        at = np.concatenate([self.at + (dx, dy), np.zeros((len(found), 2))])
        for k in self.open:
            k["miss"] += 1
        for x, y, w, h, score in found:
            centre = np.array([x + w // 2, y + h // 2], float)
            d = np.hypot(*(at[:n] - centre).T)
            i = int(d.argmin()) if n else -1  # of equals, the earlier
            if i < 0 or d[i] >= self.reach:
                at[n] = centre
                n += 1
                self.open.append({"miss": 0, "t0": t, "t1": t, "t_best": t, "box": (x, y, w, h), "score": score})
                continue
            at[i] = centre
            k = self.open[i]
            k.update(miss=0, t1=t)
            if score > k["score"]:
                k.update(score=score, box=(x, y, w, h), t_best=t)
        stay = np.array([k["miss"] <= self.misses for k in self.open], bool)
        done = [k for k, s in zip(self.open, stay, strict=True) if not s]
        self.open = [k for k, s in zip(self.open, stay, strict=True) if s]
        self.at = at[:n][stay]
        return done

    def state(self) -> list[tuple]:
        return [(*map(float, c), k["miss"], k["t0"], k["t1"], k["t_best"], *k["box"], k["score"]) for c, k in zip(self.at, self.open, strict=True)]

    def restore(self, rows: list) -> None:
        names = ("miss", "t0", "t1", "t_best")
        self.at = np.array([r[:2] for r in rows], float).reshape(-1, 2)
        self.open = [dict(zip(names, r[2:6], strict=True)) | {"box": tuple(r[6:10]), "score": r[10]} for r in rows]


def rows(video, done: list[dict], first: int = 0) -> pd.DataFrame:
    """Closed tracks with their places in closing order, from `first`."""
    cols = _CLOSED.replace(",", "").split()[::2]
    return pd.DataFrame([(video, first + i, k["t_best"], k["t0"], k["t1"], *map(int, k["box"]), k["score"]) for i, k in enumerate(done)], columns=cols)


def best_first(blobs, top: int) -> list[tuple]:
    """The `top` best blobs of a sample: by score, then from the top and from the left."""
    found = [] if blobs is None else [(b["x"], b["y"], b["w"], b["h"], b["score"]) for b in blobs]
    return sorted(found, key=lambda b: (-b[4], b[1], b[0]))[:top]


def build_tracks(samples: DataFrame, reach: float = REACH, misses: int = MISSES, top: int = TOP) -> DataFrame:
    """Tracks of all videos from (video, t, dx, dy, blobs), blobs an array of (x, y, w, h, score), numbered by score.

    A task reads the samples of its videos in order, batch by batch, and holds the open tracks of one video only;
    tracks leave as they close. What is open when a video ends closes then. Equal scores go by closing order.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, k, n = None, None, 0
        for p in parts:
            for own in (g for _, g in p.groupby("video", sort=False, dropna=False)):
                name = own["video"].iloc[0]
                if k is None or name != video and not (pd.isna(name) and pd.isna(video)):
                    if k is not None:
                        yield rows(video, k.open, n)
                    video, k, n = name, Tracker(reach, misses), 0
                done = []
                for t, dx, dy, blobs in zip(own["t"], own["dx"], own["dy"], own["blobs"], strict=True):
                    done += k.feed(t, dx, dy, best_first(blobs, top))
                yield rows(video, done, n)
                n += len(done)
        if k is not None:
            yield rows(video, k.open, n)

    dealt = samples.select("video", "t", "dx", "dy", "blobs").repartition("video").sortWithinPartitions("video", "t")
    closed = dealt.mapInPandas(run, _CLOSED)
    track = F.row_number().over(Window.partitionBy("video").orderBy(F.col("score").desc(), "closed")) - 1
    return closed.withColumn("track", track.cast("int")).select(*OUT.replace(",", "").split()[::2])
