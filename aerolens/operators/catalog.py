"""Catalogue of points: lookups, facets, distinct contents and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import confidence_rank
from ..functions.text import clip_tokens, group_label

#: Rows of a lookup table that are broadcast at most.
MOST_LOOKUP = 10_000


def lookup(df: DataFrame, rows: DataFrame, keys: list[str], value: str, override: str | None = None) -> DataFrame:
    """df with value from a lookup table; a row's own override takes precedence."""
    small = rows.limit(MOST_LOOKUP + 1).count() <= MOST_LOOKUP
    out = df.join(F.broadcast(rows) if small else rows, keys, "left")
    return out.withColumn(value, F.coalesce(F.col(override), F.col(value))) if override else out


def facet_filter(facets: dict[str, list], ranges: dict[str, tuple] | None = None, least_conf: int | None = None) -> Column:
    """One of the values within a facet, all facets together; open ends of ranges are None, and what has no value passes
    a range. A tag 'v' passes any confidence, 'x' and none pass no bound; 0 bounds nothing."""
    out = F.lit(True)
    for c, values in facets.items():
        if values:
            out = out & F.col(c).isin(values)
    for c, (lo, hi) in (ranges or {}).items():
        if lo is not None:
            out = out & ~F.coalesce(F.col(c) < lo, F.lit(False))
        if hi is not None:
            out = out & ~F.coalesce(F.col(c) > hi, F.lit(False))
    if least_conf:
        out = out & F.coalesce((F.col("conf_tag") == "v") | (F.col("conf_num") >= least_conf), F.lit(False))
    return F.coalesce(out, F.lit(False))


#: Named filters as (values of facets, least confidence). The first view is that of "Активные".
PRESETS = {
    "ТОЧНО вещи": ({"kind": ["item"], "status": ["confirmed"]}, 0),
    "На передачу штабу": ({"status": ["open"]}, 3),
    "Ложные (калибровка)": ({"status": ["rejected"]}, 0),
    "Активные": ({"status": ["confirmed", "open"]}, 0),
    "Всё": ({}, 0),
}


def preset(name: str) -> Column:
    facets, conf = PRESETS[name]
    return facet_filter(facets, least_conf=conf)


def by_kind(df: DataFrame, kinds: list[str], kind: str = "kind", num: str = "conf_num", tag: str = "conf_tag", order: str = "ord") -> DataFrame:
    """Points of the given kinds in their order, the surest first, ties as they came."""
    at = F.array_position(F.array(*map(F.lit, kinds)), F.col(kind))
    return df.where(at > 0).orderBy(at, confidence_rank(F.col(num), F.col(tag)).desc(), F.col(order))


def facet_counts(df: DataFrame, facets: list[str], passes: Column) -> DataFrame:
    """(facet, value, visible, total) of every facet in one pass: counts are combined per row before the shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets]))
    return df.select(passes.alias("p_"), each.alias("f_")).groupBy("f_.facet", "f_.value").agg(F.count_if("p_").alias("visible"), F.count("*").alias("total"))


def first_of_content(df: DataFrame, content: str, order: list[str], keep: list[str]) -> DataFrame:
    """The first row by order of each content (by MD5); combined before the shuffle, so copies don't pile up in a task."""
    first = F.min(F.struct(*order, *[c for c in keep if c not in order]))
    g = df.withColumn("md5", F.md5(F.coalesce(content, F.lit("")))).groupBy("md5").agg(first.alias("f_"))
    return g.select("md5", "f_.*")


def token_join(tokens: DataFrame, names: DataFrame, token: str, name: str) -> DataFrame:
    """Distinct pairs where token is a substring of name, by equality: names are cut into substrings of the lengths
    that tokens have, which are few."""
    lengths = [r[0] for r in tokens.select(F.length(token)).distinct().collect() if r[0]]
    if not lengths:
        return tokens.select(token).join(names.select(name), F.lit(False)).limit(0)

    def cut(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - (n - 1))), lambda i: F.substring(F.col(name), i, F.lit(n)))

    subs = F.array_distinct(F.flatten(F.array(*map(cut, lengths))))
    return names.select(name, F.explode(subs).alias(token)).join(tokens.select(token).distinct(), token).distinct()


def unmatched(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of df that a lookup table lacks."""
    return df.select(*keys).distinct().join(rows, keys, "left_anti")


def source_paths(labels: DataFrame, key: str, label: str, sources: DataFrame, path: str = "path") -> DataFrame:
    """(key, path): the sources whose file names hold a token of the label. A token of a picture meets pictures only, another token only others."""
    picture = lambda c: F.lower(c).endswith(".jpg")
    t = labels.select(key, F.explode(clip_tokens(F.col(label))).alias("token_"))
    t = t.select(key, F.regexp_replace("token_", r"\.JPG$", "").alias("token_"), F.col("token_").endswith(".JPG").alias("picture_"))
    s = sources.select(path).distinct().select(path, F.element_at(F.split(path, "/"), -1).alias("name_"), picture(F.col(path)).alias("picture_"))
    pairs = token_join(t, s, "token_", "name_")
    return t.join(pairs, "token_").join(s, ["name_", "picture_"]).select(key, path).distinct()


def montages(files: DataFrame, families: dict[str, str | None], path: str = "path") -> DataFrame:
    """(grp, name, dir) of the directories below those of `families` that hold a montage_00.jpg, sorted by group and name.

    families: directory -> group of all below it, or None for a group by each one's name.
    """
    dirs = files.where(F.col(path).endswith("/montage_00.jpg")).select(F.substring_index(path, "/", -2).alias("tail_"), F.regexp_replace(path, "/montage_00\\.jpg$", "").alias("dir"))
    dirs = dirs.select("dir", F.substring_index("tail_", "/", 1).alias("name")).withColumn("parent_", F.regexp_replace("dir", "/[^/]+$", ""))
    out = None
    for top, grp in families.items():
        own = dirs.where(F.col("parent_").endswith(top)).select((group_label(F.col("name")) if grp is None else F.lit(grp)).alias("grp"), "name", "dir")
        out = own if out is None else out.unionByName(own)
    return out.distinct().orderBy("grp", "name")


def grouped(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, rows): the rows of each group, sorted by the columns; groups in alphabetical order."""
    return df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows")).orderBy(group)


def missing(wanted: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(there, keys, "left_anti")
