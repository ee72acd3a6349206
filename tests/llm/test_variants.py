"""Personal data, spelling variants and centroid clusters against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.llm import centroids, personal, spelling

EXTRA = "found string, kind string, text_ string, word string, d_ string, v string, key string"
DOCS = f"doc_id long, text string, lang string, n_chars long, {EXTRA}"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, None, len(t) if t is not None else None, *(["x"] * 7)) for i, t in rows], DOCS).repartition(3)


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def _right(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == 1:
        return all(int(x) <= 255 for x in m.split("."))
    if kind == 2:
        return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == 0 or 9 <= len(d) <= 15


def _base(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if _right(k, m[0]))


def test_personal_anchors_equal_patterns():
    rng = random.Random(3)
    bits = ["a", "B9", "@", ".", "-", "_", "+", "1", "25", "255", "256", "0009", " ", "(", ")", "é", "://", "4242424242424242", "4242 4242-4242 4242", "\n", "%"]
    n = 0
    for _ in range(20000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        want = _base(text)
        assert [x for x in personal.find(text) if x[1] < personal.BASE] == want, text
        n += len(want)
    assert n > 5000


def test_personal_added_kinds():
    def said(t):
        return [(personal.KINDS[k], t[s:e]) for s, k, e in personal.find(t) if k >= personal.BASE]

    assert said("see https://ann:pw1@host.example/x, http://host.example/ann") == [("login", "https://ann:pw1@host.example")]
    assert said("IBAN: DE89 3704 0044 0532 0130 00, iban DE88370400440532013000") == [("iban", "IBAN: DE89 3704 0044 0532 0130 00")]
    assert said("Ssn: 123-45-6789 ssn 000-45-6789 ssn 123-00-6789 123-45-6789") == [("ssn", "Ssn: 123-45-6789")]
    assert personal.find("Nothing here: @ :// + 12 iban ssn a@b 1.2.3 +12") == []


def test_personal_spans(spark):
    rows = [(1, "mail a.b@c.org, 10.0.0.1"), (2, None), (3, ""), (None, "+1 (743) 555-3824"), (1, "mail a.b@c.org, 10.0.0.1"), (4, "é" * 70000 + "x@y.zz " + "word " * 400000 + "4242424242424242"), (5, "clean words only")]
    got = personal.personal_spans(_docs(spark, rows)).collect()
    want = sorted((str(i), _base(t or "")) for i, t in rows)
    assert sorted((str(r["doc_id"]), [tuple(x) for x in r["found"]]) for r in got) == want
    assert personal.personal_spans(_docs(spark, [])).count() == 0
    docs = _docs(spark, rows)
    masked = personal.mask(docs)
    assert masked.columns == docs.columns
    got = {r["doc_id"]: r for r in masked.collect()}
    assert masked.count() == len(rows) and got[1]["text"] == "mail [EMAIL], [IP]" and got[1]["n_chars"] == 18
    assert got[2]["text"] is None and got[2]["n_chars"] is None and got[5]["text"] == "clean words only" and got[5]["found"] == "x"


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(count):
    out = {}
    for w, n in count.items():
        near = [v for v in count if _one_edit(w, v)]
        top = min(near, key=lambda v: (-count[v], v), default=None)
        out[w] = [n, len(near), *((top, count[top]) if top is not None and count[top] >= 10 * n else (None, None))]
    for w in out:
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        out[w].append(root)
    return {w: tuple(x) for w, x in out.items()}


def test_neighbours_of_dense_words(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("aé") for _ in range(rng.randint(7, 9))) for _ in range(250)}
    words |= {"aaaaaaa" + "a" * i for i in range(6)} | {"prefixes", "prefix", "prefixed", "prefixe", "zprefixes", "refixes", "z" * 3000, "z" * 1500 + "y" + "z" * 1499, "z" * 3001}
    words = {w for w in words if len(w) >= 7}
    got = spelling.neighbours(spark.createDataFrame([(w,) for w in words] + [("aaaaaaa",)], "word string")).collect()
    want = {(a, b) for a in words for b in words if _one_edit(a, b)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) > 300


def test_neighbours_meet_no_other_half(spark):
    """Near the root a state follows its own word only: rows of the first level do not grow with the alphabet."""
    words = [(f"abc{chr(97 + i % 26)}{chr(97 + i // 26)}{'q' * (i % 5)}xyzuvw",) for i in range(600)]
    w = spark.createDataFrame(words, "word string").distinct()
    states = w.select(F.lit(0).alias("way"), F.col("word").alias("key"), F.expr("substring(word, 4)").alias("rest"), F.substring("word", 1, 3).alias("node"), F.lit(0).alias("edits"))
    assert spelling.advanced(states).count() <= w.count()


def test_spelling_variants(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["Example", "exampel", "different", "DIFFERENT", "différent", "differentt", "short", "straße", "ÀÉÎÕÜàé", "a1b2c3", "letterrs"]) for _ in range(rng.choice([0, 5, 300])))) for i in range(60)]
    rows += [(99, None), (98, ""), (None, "unnamed unnamed unnamed"), (97, "example " * 3000), (97, "example " * 3000), (96, "exampli exampli examqli examqli " + "different" * 2000)]
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    docs = _docs(spark, rows)
    got = spelling.variants(spelling.frequent_words(docs))
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got.collect()}
    assert got == _variants(count) and any(x[2] for x in got.values())
    assert spelling.variants(spelling.frequent_words(_docs(spark, []))).count() == 0


def test_chains_of_forms(spark):
    rows = [("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000), ("aaaaaac", 20), ("zzzzzzzz", 5)]
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == _variants(dict(rows))
    assert got["aaaaaaa"] == (2, 2, "aaaaaab", 20, "aaaabbb")


def _clusters(kept, k=40, rounds=5):
    rows = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in kept]
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in rows)[:k]
    cent = [v for _, v in first]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(cent)) for _, v in rows]

    for _ in range(rounds):
        own = [j for _, j in assign()]
        for j in range(len(cent)):
            mine = [v for (_, v), o in zip(rows, own, strict=True) if o == j]
            if mine:
                cent[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    done = assign()
    total = Counter()
    for d, j in done:
        total[j] += d
    return sorted((str(i), j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, cent[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(rows, done, strict=True))


@pytest.mark.parametrize(("n", "kind"), [(140, "float"), (25, "double"), (0, "float")])
def test_centroid_clusters(spark, n, kind):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=64) / 8)], i % 3) for i in range(n)]
    if n:
        rows += [rows[0], rows[1], (None, rows[2][1], 1), (500, [0.0] * 64, None), (501, [-0.001] * 64, 2), (502, rows[3][1], 0), (505, [4000.5] * 64, 0)]
    odd = [(600, None, 1), (601, [], 1), (602, [0.5] * 63, 1), (603, [0.5] * 65, 1), (604, [None] + [0.5] * 63, 1), (605, [float("nan")] + [0.5] * 63, 1), (606, [float("inf")] + [0.5] * 63, 1)]
    df = spark.createDataFrame([(i, v, lab, "x", "y") for i, v, lab in rows + odd], f"vec_id long, embedding array<{kind}>, label int, v string, cluster string").repartition(3)
    got = sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in centroids.cluster(df).collect())
    assert got == _clusters([(i, v) for i, v, _ in rows])


def test_lookup_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows, cent = rng.integers(-(2**27), 2**27, (50, 7)), rng.integers(-(2**27), 2**27, (5, 7))
    assert (centroids.distances(rows, cent) == ((rows[:, None] - cent[None]) ** 2).sum(axis=2)).all()
    with pytest.raises(Exception, match="would not fit"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()
