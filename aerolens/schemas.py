"""Row types of the data model."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def struct(**kinds) -> StructType:
    return StructType([StructField(k, v, True) for k, v in kinds.items()])


D, I, L, S, B = DoubleType(), IntegerType(), LongType(), StringType(), BooleanType()
TELEMETRY = struct(time_s=D, lat=D, lon=D, alt_m=D, alt_rel_m=D, ac_yaw=D, ac_pitch=D, ac_roll=D, gb_yaw=D, gb_pitch=D)
BLOB = struct(x=I, y=I, w=I, h=I, area=I, score=D)
DETECTION = struct(frame=S, blob=I, bbox=S, area=I, rgb=S, score=D)
TRACK = struct(track=I, t_best=D, t0=D, t1=D, bbox=S, score=D, lat=D, lon=D, alt=D)
FOCAL = struct(video=S, t=D, f=D)
COVERAGE = struct(t=D, f_px=D, dist_m=D, gsd_cm=D, obj8px_cm=D, status=S)
CELL = struct(lat=D, lon=D, alt_m=D, looked=I, seen=I, best_obj8_cm=D, min_dist_m=D)
PROJECTION = struct(name=S, video=S, t=D, drone_lat=D, drone_lon=D, drone_alt=D, yaw=D, pitch=D, hit_lat=D, hit_lon=D, hit_alt=D, dist_m=D, drift30_m=D, offset_m=D, verdict=S)
TRIAL = struct(frame=S, width=I, bg=S, x=I, y=I, size=I, contrast=D, colour=S, rank=I, score=D, dirty=I, blur=D, noise=D, clipped=D, de_peak=D, de_mean=D, bg_L=D)
MANIFEST = struct(path=S, file_id=S, size=L)
MESSAGE = struct(topic=S, id=L, ts=S, sender=S, text=S, media=S, action=S, forum_topic=B)
POINT = struct(kind=S, src=S, status=S, conf_num=I, conf_tag=S, lat=D, lon=D, alt=D, name=S, coord=S, video=S, tc=S, desc=S, imgs=ArrayType(S), who=S, view=struct(az=D, incl=D), gps=struct(lat=D, lon=D, dist=D), unc=D)
