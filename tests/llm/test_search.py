"""Ranked search, spelling variants and language models against brute force, and on awkward rows."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom.llm import langid, ranking, spelling

DOCS = "doc_id bigint, text string, lang string, item_id string, rank int, score string, word string, id int"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "clash", "x", 1, "y", "z", 2) for r in rows], DOCS).repartition(3)


# 11

TEXTS = [
    (1, "The cat sat on the mat"), (2, "the CAT sat on the mat"), (3, ""), (4, None), (None, "the cat, the cat; the cat"), (5, "  \n\t.,;"),
    (6, "Ünï—日本語 cat42 mat"), (7, "dog " * 5000 + "cat"), (8, "the cat sat on the mat"), (8, "the cat sat on the mat"), (9, "l'été cat"), (-3, "mat\x00cat\x7fdog"),
] + [(100 + i, f"filler{i % 7} the mat word{i % 3}") for i in range(40)]
ITEMS = [(1, "cat mat"), (2, "the the THE"), (3, "nothing here matches xyzzy"), (4, None), (5, ""), (None, "dog 日本語"), (7, "cat mat"), (1, "filler3 word2 été"), (7, "cat mat")]


def ranked(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = [(d, term.findall(lower(t or ""))) for d, t in docs]
    n_docs, length = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    out = []
    for item, text in items:
        scores = []
        for d, t in terms:
            tf, m, s = Counter(t), 10 + (90 * len(t) * n_docs) // max(1, length), 0
            for x in set(term.findall(lower(text or ""))):
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m)) if tf[x] else 0
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize(("entries", "chunk"), [(ranking.BLOCK_ENTRIES, ranking.CHUNK), (3, 5)])
def test_ranked_search_is_brute_force(spark, monkeypatch, entries, chunk):
    monkeypatch.setattr(ranking, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(ranking, "CHUNK", chunk)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id bigint, text string, doc_id string")
    found = ranking.search(frame(spark, TEXTS), items, k=4)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == ranked(TEXTS, ITEMS, 4)


def test_ranked_search_on_empty_tables_and_string_ids(spark):
    items = spark.createDataFrame([(1, "cat")], "item_id bigint, text string")
    docs = frame(spark, TEXTS)
    assert ranking.search(docs.limit(0), items).count() == 0
    assert ranking.search(docs, items.limit(0)).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    texts = [(None if d is None else f"d{d}", t) for d, t in TEXTS]
    assert Counter(tuple(r) for r in ranking.search(named, items).collect()) == ranked(texts, [(1, "cat")], 10)


def test_radix_order_is_stable():
    keys = np.random.default_rng(0).integers(0, 1 << 40, 5000) // (1 << 30)
    assert (ranking.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert (ranking.radix_order(keys << 31) == np.argsort(keys, kind="stable")).all()


# 12


def edits(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def grouped(counts, times=5):
    near = defaultdict(list)
    for u, v in itertools.combinations(counts, 2):
        if edits(u, v):
            near[u].append(v)
            near[v].append(u)
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def test_spelling_variants_of_texts(spark):
    rng = np.random.default_rng(1)
    stems = ["Éléphant", "mountain", "straße", "maintain", "fountain", "größer", "x" * 300, "kürbisse", "abcdef"]
    rows = [(i, " ".join(s if rng.random() > 0.1 else s[:3] + s[4:] for s in rng.choice(stems, 30))) for i in range(60)]
    rows += [(None, "mountain " * 7), (3, None), (4, ""), (5, "a b c 1234567"), rows[0], rows[0], (99, "mountains×s÷" * 4000)]
    counts = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w
            counts[w] += len(w) >= 6
    counts = {w: n for w, n in counts.items() if n >= 5}
    assert set(map(tuple, spelling.group_variants(frame(spark, rows)).collect())) == grouped(counts)
    assert spelling.group_variants(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 5, 64])
def test_spelling_variants_subdivide_hot_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = np.random.default_rng(block)
    words = {"".join(rng.choice(list("abc"), n)) for n in (6, 7, 8, 9) for _ in range(90)} | {"same" * 4 + x for x in "abcdefghij"} | {"same" * 4, "same" * 5}
    counts = {w: int(rng.integers(5, 4000) ** (1 + i % 2)) for i, w in enumerate(sorted(words))}
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert set(map(tuple, spelling.variants(table).collect())) == grouped(counts)


# 13


def chance(counts, order):
    """p(run) of an interpolated Kneser-Ney model, from its definition."""
    tables = {order: dict(counts)}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])

    def p(run):
        n = len(run)
        if n == 0:
            return 1 / (len(tables[1]) + 1)
        t = tables[n]
        ones, twos = sum(c == 1 for c in t.values()), sum(c == 2 for c in t.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        same = [c for g, c in t.items() if g[:-1] == run[:-1]]
        if not same:
            return p(run[1:])
        return max(t.get(run, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * p(run[1:])

    return p


EN = ["the cat and the dog sat there", "this is that other thing", "THE rain, the wind!", "another thing that they gather"]
ES = ["el perro y la casa de la ciudad", "una noche más en la playa", "el niño come la manzana", "las cosas de la vida"]


def padded(text):
    out = re.sub(r"[\W\d_]+", " ", text.lower()).lstrip()
    return "\x02" * 3 + out


def test_language_models_are_kneser_ney(spark):
    train = spark.createDataFrame([("en", t) for t in EN] + [("es", t) for t in ES], "lang string, text string").repartition(3)
    held = langid.fit(train).toPandas()
    models = [langid.Model(held[held["lang"] == x]) for x in ("en", "es")]
    texts = ["the thing that", "la playa", "zzz", "¿niño?", None, "12 34"]
    n, h = langid.cross_entropies(pd.Series(texts), models)
    assert n.tolist() == [14, 8, 3, 5, 0, 0]
    for k, corpus in enumerate((EN, ES)):
        p = chance(Counter(padded(t)[i : i + 4] for t in corpus for i in range(len(padded(t)) - 3)), 4)
        for i in range(4):
            x = padded(texts[i])
            assert h[i, k] == pytest.approx(-np.mean([math.log(p(x[j : j + 4])) for j in range(len(x) - 3)]), abs=1e-9)


def test_languages_are_told_apart(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        words = " ".join(EN if i % 3 else ES).split()
        rows.append((i, " ".join(rng.choice(words, 12)), "en" if i % 3 else "es"))
    rows += [(1000, None, "en"), (1001, "", "es"), (1002, "123 !?", "en"), (None, "the cat and the dog", "en"), (1003, "the dog " * 9000, None), (1004, "一二三四五六七八九十" * 5, None), rows[0]]
    docs = frame(spark, rows)
    got = langid.identify(docs)
    assert got.count() == len(rows)
    out = {r["doc_id"]: r for r in got.collect()}
    for d, t, lang in rows:
        r = out[d]
        assert r["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if not t or not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
        elif lang and d is not None:
            assert r["lang_pred"] == lang
    assert out[1003]["lang_pred"] == "en" and not out[1004]["accepted"] and out[1004]["lang_pred"] != "und"
    strict = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, reject=True).collect()}
    assert strict[1004] == "und" and strict[1003] == "en"
    monkeypatch.setattr(langid, "MAX_ENTRIES", 1)
    monkeypatch.setattr(langid, "PIECE", 7)
    again = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for d in out:
        assert again[d]["lang_pred"] == out[d]["lang_pred"] and again[d]["score"] == pytest.approx(out[d]["score"], abs=1e-6)


def test_languages_of_nothing(spark):
    docs = frame(spark, [(1, "some text", None), (2, None, None)])
    assert {r["lang_pred"] for r in langid.identify(docs).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0
