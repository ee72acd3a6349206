"""Personal data by anchor expansion.

One Aho-Corasick automaton runs over a whole text and stops at anchors only: at-signs, schemes, plus signs before a
digit, digits, and cues of identifiers in any mix of case. From an anchor a small deterministic parser walks to the left and
right as far as its kind allows, and then checks what it holds: label structure, value ranges, check digits. Each kind remembers where its last
candidate ended, so no character is walked over more than a few times and the result is that of the leftmost
non-overlapping matches of a pattern.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The order of kinds, the base first: email, network address, payment card, phone; then logins in addresses, bank accounts, social security numbers.
KINDS = ("email", "ip", "card", "phone", "login", "iban", "ssn")
BASE = 4
SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"

#: What the parsers walk over, by kind. The repeats that can't give back are possessive.
_LABELS = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_QUAD = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DIGITS = re.compile(r"[0-9]++")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
_OTHER = re.compile(r"[^0-9]+")
_DIAL = re.compile(r"[\x20().0-9-]*+")
_LOGIN = re.compile(r"://[A-Za-z0-9._~%+-]++(?::[A-Za-z0-9._~%+!$*-]*+)?@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
_IBAN = re.compile(r"[:\x20]*+[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?")
_SSN = re.compile(r"[:#\x20]*+([0-9]{3})-([0-9]{2})-([0-9]{4})")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEMES = ("http", "https", "ftp", "ssh")
DECIMAL = "0123456789"


def luhn(digits: str) -> bool:
    """Whether the check digit is right: from the right, every second digit doubled, the sum of all figures a multiple of ten."""
    even, odd = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, even)) + sum(sum(divmod(2 * int(d), 10)) for d in odd)) % 10 == 0


def account_checks(value: str) -> bool:
    """Whether an account number without spaces, 15 to 34 characters, leaves 1 modulo 97."""
    turned = value[4:] + value[:4]
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


@lru_cache(maxsize=1)
def automaton():
    """Anchors and what they stand for: e at-sign, s scheme, p plus before a digit, d digit, b bank account cue, n number cue."""
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("e", 1))
    a.add_word("://", ("s", 3))
    for d in DECIMAL:
        a.add_word(d, ("d", 1))
        a.add_word(f"+{d}", ("p", 2))
    for kind, cue in (("b", "iban"), ("n", "ssn")):
        for letters in product(*((c, c.upper()) for c in cue)):
            a.add_word("".join(letters), (kind, len(cue)))
    a.make_automaton()
    return a


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all personal data in a text, sorted: kind is a place in KINDS, places are code points, end exclusive."""
    out = []
    done = [0] * len(KINDS)  # where the last candidate of each kind ended

    def keep(kind: int, start: int, end: int, right: bool) -> None:
        done[kind] = end
        if right:
            out.append((start, kind, end))

    for last, (anchor, length) in automaton().iter(text):
        at = last - length + 1
        if anchor == "d":
            if at >= done[2]:
                end = _CHAIN.match(text, at).end()
                digits = text[at:end].replace(" ", "").replace("-", "") if 12 <= end - at < 40 else ""
                keep(2, at, end, 12 <= len(digits) <= 19 and luhn(digits))
            if at >= done[1]:
                m = _QUAD.match(text, at)
                if m:
                    keep(1, at, m.end(), all(len(p) <= 3 or not p[:-3].strip("0") for p in m.groups()) and all(int(p[-3:]) <= 255 for p in m.groups()))
                else:
                    done[1] = _DIGITS.match(text, at).end()
        elif anchor == "p":
            end = _DIAL.match(text, last + 1).end()
            while end > last + 1 and text[end - 1] not in DECIMAL:
                end -= 1
            if end > last + 2:
                keep(3, at, end, 9 <= len(_OTHER.sub("", text[at:end])) <= 15)
        elif anchor == "e":
            start = at
            while start > done[0] and text[start - 1] in _LOCAL:
                start -= 1
            m = _LABELS.match(text, at) if start < at else None
            if m:
                keep(0, start, m.end(), True)
        elif anchor == "s":
            start = at - max((len(s) for s in SCHEMES if text.endswith(s, done[4], at)), default=0)
            m = _LOGIN.match(text, at) if start < at else None
            if m:
                keep(4, start, m.end(), True)
        elif anchor == "b" and at >= done[5]:
            m = _IBAN.match(text, last + 1)
            if m:
                keep(5, at, m.end(), account_checks(m[0].lstrip(": ").replace(" ", "")))
        elif anchor == "n" and at >= done[6]:
            m = _SSN.match(text, last + 1)
            if m:
                keep(6, at, m.end(), m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000")
    return sorted(out)


def _each(make, kind: pa.DataType):
    """An Arrow function of (text, ...) batches that puts make(text) in place of the text; a null counts as empty."""

    def run(batches):
        for b in batches:
            got = pa.array((make(t.as_py() or "") for t in b.column(0)), kind)
            yield pa.RecordBatch.from_arrays([got, *b.columns[1:]], names=b.schema.names)

    return run


_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id and found, an array of (start, kind, end), for each row of docs, of whose columns only doc_id and text are read.

    A null or empty text has no span, repeated rows stay repeated, a null doc_id stays null, an empty table gives no
    rows. Spans of different kinds may overlap; those of one kind never do. Texts of any length are read whole, in time that grows with the length.
    """

    def make(text: str) -> list[dict]:
        return [{"start": s, "kind": k, "end": e} for s, k, e in find(text)]

    rows = docs.select(F.col("text").cast("string").alias("found"), F.col("doc_id").cast("long"))
    return rows.mapInArrow(_each(make, _SPAN_TYPE), f"found {SPANS}, doc_id long").select("doc_id", "found")


def masked_text(text: str) -> str:
    """The text with `[KIND]` for each run of spans, named after the run's first and longest span."""
    out, at = [], 0
    for start, kind, end in sorted(find(text), key=lambda x: (x[0], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """docs, all columns and rows, with a mark in place of each run of personal data. A null text stays null; n_chars, if there is that column, follows."""

    def make(text: str) -> str:
        return masked_text(text)

    own = docs.select(F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("d_"))
    schema = own.schema
    rows = own.mapInArrow(_each(make, pa.string()), schema)
    new = {"text": F.when(F.col("d_.text").isNotNull(), F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("text") != F.col("d_.text"), F.length("text").cast("long")).otherwise(F.col("d_.n_chars"))
    return rows.select(*[new.get(c, F.col("d_")[c]).alias(c) for c in docs.columns])


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"], x["end"])), ",")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(BASE)), F.sha2(_joined(F.filter("found", lambda x: x["kind"] < BASE)), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


QUERIES = {"op11_personal_data": op11_personal_data}

#: Patterns of the kinds for the SQL check, with what the match m must fulfil.
_DIGITS_OF = "regexp_replace(m, '[^0-9]', '', 'g')"
_SQL_KINDS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0"),
    (
        r"[0-9]([\x20-]?[0-9])+",
        f"length({_DIGITS_OF}) BETWEEN 12 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS_OF}), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT ELSE (2 * d::INT) // 10 + (2 * d::INT) % 10 END)) % 10 = 0",
    ),
    (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS_OF}) BETWEEN 9 AND 15"),
    (r"(https|http|ftp|ssh)://[A-Za-z0-9._~%+-]+(:[A-Za-z0-9._~%+!$*-]*)?@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*", "true"),
    (
        r"[iI][bB][aA][nN][:\x20]*[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?",
        "length(regexp_replace(m[5:], '[: ]', '', 'g')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(regexp_replace(m[5:], '[: ]', '', 'g')[5:] || regexp_replace(m[5:], '[: ]', '', 'g')[1:4], ''), lambda c: CASE WHEN ascii(c) < 58 THEN (ascii(c) - 48)::BIGINT ELSE (ascii(c) - 55)::BIGINT END)), lambda a, b: (CASE WHEN b < 10 THEN a * 10 + b ELSE a * 100 + b END) % 97) = 1",
    ),
    (r"[sS][sS][nN][:#\x20]*[0-9]{3}-[0-9]{2}-[0-9]{4}", "m[-11:-9] NOT IN ('000', '666') AND m[-11:-9] < '900' AND m[-7:-6] <> '00' AND m[-4:] <> '0000'"),
)


def _sql() -> str:
    parts = [f"SELECT doc_id, r, {k} AS k, list_transform(string_split_regex(text, p), lambda x: length(x)) AS gap, regexp_extract_all(text, p, 0) AS hit FROM d, (SELECT '{p}' AS p)" for k, (p, _) in enumerate(_SQL_KINDS)]
    right = " ".join(f"WHEN k = {k} THEN {check}" for k, (_, check) in enumerate(_SQL_KINDS))
    named = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), m AS ({" UNION ALL ".join(parts)}),
l AS (SELECT *, list_transform(hit, lambda x: length(x)) AS len FROM m WHERE len(hit) > 0), i AS (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM l),
s AS (SELECT r, k, hit[i] AS m, (list_sum(gap[1:i]) + coalesce(list_sum(len[1:i - 1]), 0))::BIGINT AS start, (list_sum(gap[1:i]) + list_sum(len[1:i]))::BIGINT AS stop FROM i),
v AS (SELECT *, {named}[k + 1] || ':' || start || ':' || stop AS said FROM s WHERE CASE {right} END),
g AS (SELECT r, {", ".join(f"count(*) FILTER (k = {k}) AS n{k}" for k in range(BASE))}, string_agg(said, ',' ORDER BY start, k) FILTER (k < {BASE}) AS base, string_agg(said, ',' ORDER BY start, k) AS spans FROM v GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n{k}, 0) AS n_{KINDS[k]}" for k in range(BASE))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""


SQL: dict[str, str] = {"op11_personal_data": _sql()}
