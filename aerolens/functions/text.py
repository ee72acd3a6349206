"""Names, slugs, snippets and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin for Cyrillic letters, one for one, in several letters, and letters that go.
CYRILLIC, LATIN = "абвгдеёзийклмнопрстуфыэ", "abvgdeeziiklmnoprstufye"
LONGER = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya"}
SILENT = "ъь"
#: How names of clips stand in labels, and paths of assets in pages.
FULL_NAME, SHORT_NAME, TIME, CUT_NAME = r"DJI_\d{14}_\d{4}_Z(?:\.JPG)?", r"C\d{4}", r"(?<![0-9])\d{6}(?![0-9])", r"DJI_(\d{14})(?!\d|_\d{4}_Z)"
ASSET = r"(?:analysis|docs|data)/[A-Za-z0-9_./\-]+\.(?:jpe?g|png|JPG|PNG)"


def slug(text: Column, known: Column | None = None, empty: str = "topic") -> Column:
    """Lower-case letters and digits joined by '-', Cyrillic in Latin letters; `known` names take precedence, and what would be empty is `empty`."""
    t = F.translate(F.lower(text), CYRILLIC + SILENT, LATIN)
    for letter, more in LONGER.items():
        t = F.replace(t, F.lit(letter), F.lit(more))
    out = F.btrim(F.regexp_replace(t, "[^a-z0-9]+", "-"), F.lit("-"))
    out = F.when(out == "", empty).otherwise(out)
    return out if known is None else F.coalesce(known, out)


def snippet(text: Column, most: int = 160) -> Column:
    """White space collapsed; longer than `most`, cut with dots."""
    t = F.btrim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " "))
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most - 3)), F.lit("..."))).otherwise(t)


def display_name(first: Column, last: Column, title: Column, username: Column, ident: Column) -> Column:
    """The first that is there of both names, title, user name and id; '?' for no sender at all."""
    there = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(there(F.concat_ws(" ", there(first), there(last))), there(title), there(username), ident.cast("string"), F.lit("?"))


def strip_namespace(tag: Column) -> Column:
    return F.substring_index(tag, "}", -1)


def clip_tokens(label: Column) -> Column:
    """Distinct tokens that tell clips: full names with their .JPG, short names, six-digit times that stand alone, and the
    last six digits of names that are cut off after their time."""
    all_ = lambda p, group=0: F.regexp_extract_all(F.coalesce(label, F.lit("")), F.lit(p), F.lit(group))
    cut = F.transform(all_(CUT_NAME, 1), lambda x: F.right(x, F.lit(6)))
    return F.array_distinct(F.concat(all_(FULL_NAME), all_(SHORT_NAME), all_(TIME), cut))


def group_label(directory: Column) -> Column:
    """The day of a drone's directory, or that of a helicopter."""
    day = F.regexp_extract(directory, r"^DJI_2026(\d{2})(\d{2})", 2)
    month = F.regexp_extract(directory, r"^DJI_2026(\d{2})(\d{2})", 1)
    return F.when(day != "", F.concat(F.lit("Дрон "), day, F.lit("."), month)).otherwise(F.lit("Вертолёт"))


def asset_paths(html: Column) -> Column:
    """Paths of images in a page or in its data, distinct."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(ASSET), F.lit(0)))
