"""Units, angles, distances, colours and time codes, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a degree of latitude, and of longitude at the equator.
LAT_M, LON_M = 111132.0, 111320.0
#: Turn in degrees that a fixed step needs, and focal lengths in pixels that are believed.
STEP_DEG, FOCAL_BAND = 0.8, (1000.0, 20000.0)
#: Scales that a chain of homographies may have.
SCALES = (0.25, 4.0)
#: Bins of the three colour planes.
BINS = (16, 32, 32)


def number(text: Column) -> Column:
    """A double, or null for what is no finite number."""
    x = text.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ascii_text(b: Column) -> Column:
    return F.trim(F.translate(F.decode(b, "US-ASCII"), "\0", ""))


def lon_metres(lat: Column) -> Column:
    return F.cos(F.radians(lat)) * LON_M


def plane_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, scale_lat: Column) -> Column:
    """Metres between two places on the local plane; longitudes are scaled at scale_lat."""
    return F.hypot((lat1 - lat2) * LAT_M, (lon1 - lon2) * lon_metres(scale_lat))


def turn_half(x: Column) -> Column:
    """Degrees in [-180, 180)."""
    return x - F.floor((x + 180) / 360) * 360


def turn_full(x: Column) -> Column:
    """Degrees in [0, 360)."""
    return x - F.floor(x / 360) * 360


def ray(yaw: Column, pitch: Column, px: Column, py: Column, w: Column, h: Column, f: Column) -> Column:
    """Direction of a pixel as a unit vector (e, n, u)."""
    az = F.radians(yaw) + F.atan2(px - w / 2, f)
    el = F.radians(pitch) - F.atan2(py - h / 2, f)
    return F.struct((F.sin(az) * F.cos(el)).alias("e"), (F.cos(az) * F.cos(el)).alias("n"), F.sin(el).alias("u"))


def gsd_cm(dist_m: Column, f_px: Column) -> Column:
    return F.try_divide(dist_m, f_px) * 100


def focal_from_turn(dx: Column, dy: Column, dyaw: Column, dpitch: Column, pitch: Column) -> Column:
    """Focal length in pixels from image shift and camera turn (degrees), if one axis outweighs the other twice."""
    across = F.try_divide(-dx, F.radians(dyaw) * F.cos(F.radians(pitch)))
    along = F.try_divide(dy, F.radians(dpitch))
    return F.when(F.abs(dyaw) > 2 * F.abs(dpitch), across).when(F.abs(dpitch) > 2 * F.abs(dyaw), along)


def focal_from_step(dx: Column, dy: Column, dyaw: Column, dpitch: Column, pitch: Column, least: float = STEP_DEG) -> Column:
    """Focal length in pixels by yaw if it turns more than `least` degrees and outweighs pitch twice, else by pitch if that does."""
    across = F.try_divide(-dx, F.radians(dyaw) * F.cos(F.radians(pitch)))
    along = F.try_divide(dy, F.radians(dpitch))
    return F.when((F.abs(dyaw) > least) & (F.abs(dyaw) > 2 * F.abs(dpitch)), across).when(F.abs(dpitch) > least, along)


def in_focal_band(f: Column) -> Column:
    return F.coalesce(f.between(*FOCAL_BAND), F.lit(False))


def object_metres(dist_m: Column, f_px: Column, pixels: float = 30) -> Column:
    """Size of what covers so many pixels at a distance."""
    return F.try_divide(dist_m, f_px) * pixels


def colour_bin(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    q = [F.floor(x * n / 256) for x, n in zip((l, a, b), BINS, strict=True)]
    return ((q[0] * BINS[1] + q[1]) * BINS[2] + q[2]).cast("long")


def rarity(density: Column) -> Column:
    return -F.log10(density + F.lit(1e-9))


def cie(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    """L 0..100, a, b, chroma and hue of eight-bit planes."""
    ca, cb = a - 128, b - 128
    return F.struct((l * 100 / 255).alias("L"), ca.alias("a"), cb.alias("b"), F.hypot(ca, cb).alias("C"), turn_full(F.degrees(F.atan2(cb, ca))).alias("hue"))


def colour_distance(d_ab: Column, d_l: Column, tol_ab: float = 8.0, tol_l: float = 28.0) -> Column:
    return F.hypot(d_ab / tol_ab, d_l / tol_l)


def timecode(t: Column) -> Column:
    s = F.floor(t).cast("long")
    return F.format_string("%02dm%02ds", F.floor(s / 60), s % 60)


def srt_time(t: Column) -> Column:
    ms = F.round(t * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def stamp_in_name(name: Column, seconds: Column | None = None, default: str = "2026-01-01 00:00:00") -> Column:
    """The 14-digit time after DJI_ in a file name, else `default`, as a timestamp without zone, and so many seconds later."""
    digits = F.regexp_extract(name, r"DJI_(\d{14})", 1)
    start = F.coalesce(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"), F.lit(default).cast("timestamp_ntz"))
    return start if seconds is None else start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def box(text: Column) -> Column:
    """'x,y,w,h' as a struct with its centre."""
    n = F.transform(F.split(text, ","), lambda x: x.try_cast("int"))
    at = lambda i: F.get(n, F.lit(i))
    return F.struct(at(0).alias("x"), at(1).alias("y"), at(2).alias("w"), at(3).alias("h"), (at(0) + F.floor(at(2) / 2)).cast("int").alias("cx"), (at(1) + F.floor(at(3) / 2)).cast("int").alias("cy"))


def sheet_place(i: Column, side: int = 6) -> Column:
    """Sheet, row and column of the i-th tile, from 0."""
    n = side * side
    return F.struct(F.floor(i / n).alias("sheet"), F.floor(i % n / side).alias("row"), (i % side).alias("col"))


def confidence_rank(num: Column, tag: Column) -> Column:
    return F.when(tag == "v", 9).when(tag == "x", -1).otherwise(F.coalesce(num, F.lit(0)))


def whisker_end(lat: Column, lon: Column, az: Column, metres: float = 140.0) -> Column:
    return F.struct((lat + F.cos(F.radians(az)) * metres / LAT_M).alias("lat"), (lon + F.sin(F.radians(az)) * metres / lon_metres(lat)).alias("lon"))


def sane_homography(m: Column, w: Column, h: Column) -> Column:
    """Whether a 3x3 matrix keeps orientation, scales within SCALES, and maps the frame to a convex quadrilateral."""
    at = lambda i: F.get(m, F.lit(i))
    det = at(0) * at(4) - at(1) * at(3)
    zero = F.lit(0.0)

    def corner(x: Column, y: Column) -> tuple[Column, Column]:
        z = at(6) * x + at(7) * y + at(8)
        return F.try_divide(at(0) * x + at(1) * y + at(2), z), F.try_divide(at(3) * x + at(4) * y + at(5), z)

    p = [corner(zero, zero), corner(w, zero), corner(w, h), corner(zero, h)]
    turns = []
    for k in range(4):
        (x0, y0), (x1, y1), (x2, y2) = p[k], p[(k + 1) % 4], p[(k + 2) % 4]
        turns.append((x1 - x0) * (y2 - y1) - (y1 - y0) * (x2 - x1))
    convex = (F.least(*turns) >= 0) | (F.greatest(*turns) <= 0)
    return F.coalesce((F.size(m) == 9) & (det > 0) & (F.sqrt(F.abs(det)) > SCALES[0]) & (F.sqrt(F.abs(det)) < SCALES[1]) & convex, F.lit(False))
