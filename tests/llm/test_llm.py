"""Operators of the training-data subpackage against brute force, and on awkward rows."""

import dataclasses
import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import common, editembed, encoder, lines, mixing, quality, sharding, simhash, tiling, tokencount, tokenout, urlfilter
from seqloom.llm.queries import QUERIES, SQL, tokenizer_file

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
ROWS = [
    (1, "The cat sat on the mat and looked at the dog for a while", "en", "a", 1),
    (2, "The cat sat on the mat and looked at the dog for a while", "en", "a", 1),
    (3, "", "en", "b", 0), (4, None, None, None, None), (5, None, "de", "b", None),
    (None, "no id at all", "en", "a", 1), (7, "   \n\t ", "en", "", 3), (8, "two words", "en", "b", 9),
    (9, LONG, "en", "b", len(LONG)), (10, "Ünïcödé ßtraße\x0bçà  et   là \n x", "fr", "ß", 1),
    (10, "Ünïcödé ßtraße\x0bçà  et   là \n x", "fr", "ß", 1), (11, "<|endoftext|> in a text <|endof", "en", "a", 3),
    (12, "x" * 70_000, "en", "c", 70_000), (13, "日本語のテキスト、空白なし。" * 40, "ja", "c", 5), (-5, "a", "en", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# 1


@pytest.mark.parametrize("bits", [urlfilter.MAX_FILTER_BITS, 1])
def test_url_rules_on_odd_urls(spark, bits):
    urls = [None, "", "example.com/en/x", "https://EXAMPLE.com/en/", "http://a.www.example.com/en/?q#f", "https://x.net/es/1", "https://net/fr/", "https://notnet/fr/", "https://x.com", "https://x.com/", "http://h?x://y", "https://b.example.com/en", "https://x.net/ES/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] * 2, "page_id bigint, url string, host string")
    out = urlfilter.apply_rules(pages, urlfilter.rules_table(spark), max_bits=bits)
    rules = urlfilter.RULES
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert out.count() == 2 * len(urls) and "__host" in out.columns
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = lower(host)
        fits = [(r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        assert got[i] == (host, path, rule, verdict), u


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = spark.range(0, 20_000, 7).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    cascade = urlfilter.build_cascade(listed, universe, first_bits=3.0, later_bits=1.5)
    assert len(cascade.levels) > 2
    rows = universe.select("key", *urlfilter.key_hashes(F.col("key"))).toPandas()
    got = cascade.member([rows[c].to_numpy() for c in urlfilter.HASHES])
    assert (got == np.array([int(k[1:]) % 7 == 0 for k in rows["key"]])).all()


def test_keys_that_share_two_hashes_are_told_apart(spark, monkeypatch):
    real = urlfilter.key_hashes
    monkeypatch.setattr(urlfilter, "key_hashes", lambda key: [F.lit(5).cast("long").alias("a"), F.lit(9).cast("long").alias("b"), real(key)[2]])
    keys = spark.range(12).select(F.col("id").cast("string").alias("key"))
    cascade = urlfilter.build_cascade(keys.where("key in ('3', '8')"), keys)
    rows = keys.select("key", *urlfilter.key_hashes(F.col("key"))).toPandas()
    assert {k for k, m in zip(rows["key"], cascade.member([rows[c].to_numpy() for c in urlfilter.HASHES]), strict=True) if m} == {"3", "8"}


# 2


def test_ridge_against_dense_numpy(spark):
    """The model's equations, fold by fold, from the features of all rows at once."""
    rng = np.random.default_rng(2)
    stats = rng.normal(size=(120, len(quality.STATS)))
    label = (stats[:, 0] + 0.3 * rng.normal(size=120) > 0).astype(int)
    rows = [(s.tolist(), int(y), i % quality.FOLDS) for i, (s, y) in enumerate(zip(stats, label, strict=True))]
    model = quality.fit(spark.createDataFrame(rows, "stats array<double>, label int, fold int").repartition(3))
    assert model.mean == pytest.approx(stats.mean(0)) and model.scale == pytest.approx(stats.std(0))
    x, fold, d = model.features(stats), np.arange(120) % quality.FOLDS, quality.FEATURES + 1
    for k in range(quality.FOLDS + 1):
        at = fold != k
        want = np.linalg.solve(x[at].T @ x[at] + quality.RIDGE * at.sum() * np.eye(d) / d, x[at].T @ label[at])
        assert model.weights[k] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_quality_learns_and_handles_odd_rows(spark, docs, empty):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9)))
    rows = []
    for i in range(300):
        words = [word() for _ in range(rng.integers(5, 60))]
        rows.append((i, " ".join(w + "###" for w in words) if i % 4 == 0 else " ".join(words) + "."))
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i, _ in rows] + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    out = quality.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), labels).toPandas()
    held = out[out["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for _, r in out.iterrows())
    assert ((held["score"] >= 0.7) == (held["doc_id"] % 4 != 0)).mean() > 0.95
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.7)).all()
    odd = quality.score_documents(docs, labels).collect()
    assert len(odd) == len(ROWS) and all(r["score"] is not None for r in odd)
    assert quality.score_documents(empty, labels).count() == 0
    assert {r["score"] for r in quality.score_documents(docs, labels.limit(0)).collect()} <= {0.495, 0.5}


def test_isotonic_is_the_least_squares_fit():
    x, y, n = np.arange(6.0), np.array([0.1, 0.5, 0.3, 0.2, 0.9, 0.8]), np.array([1.0, 2, 1, 1, 1, 3])
    centres, values = quality.isotonic(x, y, n)
    assert (np.diff(values) > 0).all() and np.isclose(values[1], (0.5 * 2 + 0.3 + 0.2) / 4) and len(centres) == 3


# 3


def brute_targets(sizes, weights, most=3):
    """Shares by weight; what is above most * size stops and the rest is shared again."""
    out, full = {}, set()
    while True:
        left = sum(sizes) - sum(most * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        share = {i: left * weights[i] / weight for i in range(len(sizes)) if i not in full}
        over = {i for i, x in share.items() if x > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in full else share[i] for i in range(len(sizes))]
        full |= over


def test_targets_stop_and_reshare(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        sizes = [int(x) for x in rng.integers(0, 1000, n) ** 2 // 100 + 1]
        names = [f"s{i:03}" for i in range(n - 1)] + [None]
        rows = [(s, x // 2) for s, x in zip(names, sizes, strict=True)] + [(s, x - x // 2) for s, x in zip(names, sizes, strict=True)]
        got = mixing.sources_of(spark.createDataFrame(rows, "source string, size bigint").repartition(3)).orderBy("rank").collect()
        assert [(r["source"], r["rank"], r["source_size"]) for r in got] == list(zip(names, range(n), sizes, strict=True))
        assert [r["target"] for r in got] == pytest.approx(brute_targets(sizes, [(5, 2, 1)[i % 3] for i in range(n)]))


def test_splitting_tree_is_exact():
    quotas, totals = np.array([1000, 3, 0, 517]), mixing.balanced(1520, 7)
    out = mixing.split_quotas(quotas, totals, np.random.default_rng(1))
    assert (out.sum(axis=1) == quotas).all() and (out >= 0).all() and (out.sum(axis=0) == totals).all()
    draws = np.array([mixing.split_quotas(np.array([6, 4]), mixing.balanced(10, 2), np.random.default_rng(k))[0, 0] for k in range(4000)])
    # a hypergeometric law: 5 of 10 blocks, 6 of them of the source
    assert draws.mean() == pytest.approx(3.0, abs=0.05) and draws.var() == pytest.approx(2 / 3, abs=0.06)


def _draws(df, **how):
    out = mixing.plan(df, **how).toPandas()
    out["draws"] = out["draws"].map(lambda x: tuple((d["shard"], d["block"]) for d in x))
    return out


def test_mixture_meets_targets(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 64)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), None if i % 9 == 0 else f"s{i % 5}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra int")
    out, again = _draws(df), _draws(df.repartition(5))
    key = lambda p: sorted((r.id, r.draws) for r in p.itertuples())
    assert key(out) == key(again) and len(out) == 900
    out["copies"] = out["draws"].map(len)
    out["taken"] = out["copies"] * out["size"]
    sums = out.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"), known=("source_size", "first"))
    assert (sums["size"] == sums["known"]).all() and (sums["taken"] - sums["target"]).abs().max() < 25
    assert sums["target"].tolist() == pytest.approx(brute_targets(sums["size"].tolist(), [5, 2, 1, 5, 2, 1]))
    assert (out["copies"] <= 3).all() and (out["copies"][out["size"] == 0] == 0).all()
    # a block of a source lies in one shard, a document in a block once, and shards are near equal
    homes, blocks = {}, Counter()
    for r in out.itertuples():
        assert len({b for _, b in r.draws}) == len(r.draws)
        for shard, block in r.draws:
            assert homes.setdefault((str(r.source), block), shard) == shard
    blocks.update(homes.values())
    assert set(blocks) == set(range(8)) and max(blocks.values()) - min(blocks.values()) <= 3
    mixed = mixing.mix(df)
    assert mixed.count() == int(out["copies"].sum()) and "extra" in mixed.columns
    odd = mixing.plan(docs)
    assert odd.count() == len(ROWS) and mixing.mix(docs).count() == odd.agg(F.sum(F.size("draws"))).first()[0]
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_many_sources_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 1000)
    df = spark.range(50_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.format_string("host%05d", F.col("id")).alias("source"))
    out = mixing.plan(df).agg(F.count("*").alias("n"), F.sum("target").alias("t"), F.sum("size").alias("s"), F.sum(F.size("draws") * F.col("size")).alias("taken")).first()
    assert out["n"] == 50_000 and out["t"] == pytest.approx(out["s"]) and out["taken"] == pytest.approx(out["s"], rel=0.35)
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", 50)
    same = spark.createDataFrame([(None, "one two three", "a")] * 600 + [(1, "b " * 50, "b")], "doc_id bigint, text string, source string")
    got = mixing.mix(same).groupBy("source").count().collect()
    want = mixing.plan(same).groupBy("source").agg(F.sum(F.size("draws")).alias("n"), F.first("target").alias("t")).collect()
    assert {r["source"]: r["count"] for r in got} == {r["source"]: r["n"] for r in want if r["n"]}
    assert all(abs(r["n"] * (3 if r["source"] == "a" else 50) - r["t"]) <= 25 for r in want)


# 4


def brute_simhash(text):
    w = WORD.findall(lower(text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [48, 0])
def test_simhash_components(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = np.random.default_rng(2)
    base = [[f"w{rng.integers(500)}" for _ in range(120)] for _ in range(6)]
    rows = [(i, t) for i, t, *_ in ROWS if i is not None and i != 9 and i != 12]
    for i in range(90):
        w = list(base[i % 6])
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(len(w))] = f"n{rng.integers(99)}"
        rows.append((100 + i, " ".join(w)))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    prints = {i: brute_simhash(t) for i, t in rows}
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if bin(prints[a] ^ prints[b]).count("1") <= 2 and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert len(got) == len(rows)
    for r in got:
        assert r["fp"][0] & (2**64 - 1) == prints[r["doc_id"]] and r["component_id"] == root(r["doc_id"])


def test_simhash_odd_rows(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and all(r["component_id"] is None for r in got if r["doc_id"] is None)
    zero = {r["doc_id"] for r in got if r["fp"][0] == 0}
    assert zero == {3, 4, 5, 7} and {r["component_id"] for r in got if r["doc_id"] in zero} == {3}
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("size", [6, 24, 40])
def test_near_copies_that_differ_in_one_token_meet(spark, size):
    rng = np.random.default_rng(11)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    rows = []
    for i in range(30):
        words = [word(rng.integers(2, 10)) for _ in range(200)]
        rows += [(2 * i + k, " ".join([*words[:-1], word(size)])) for k in range(2)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), simhash.STAGE).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i, _ in rows}


def test_hot_probes_split_into_blocks(spark, monkeypatch):
    """A bucket of 9 table rows with 3,000 probes, and one of 700 with 1,000: no side of a cell
    has over BLOCK rows, and each table row meets each probe and each other table row once."""
    monkeypatch.setattr(simhash, "BLOCK", 256)
    buckets = [(0, 9, 3000), (1, 700, 1000)]
    rows = [(0, v, i, i >= n, [i]) for v, n, p in buckets for i in range(n + p)]
    left, right = simhash._cells(spark.createDataFrame(rows, "seg int, v bigint, id bigint, probe boolean, of array<bigint>"))
    by = ["seg", "v", "probes", "i", "j"]
    for x in (left, right):
        assert x.groupBy(*by).count().agg(F.max("count")).first()[0] <= 256
    met = left.join(right.withColumnRenamed("id", "other"), by).select("v", "id", "other").where("id <> other")
    want = sum(n * p + n * (n - 1) // 2 for _, n, p in buckets)
    pairs = met.select("v", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    assert pairs.distinct().count() == want


@pytest.mark.parametrize(("hot", "block"), [(8, 1024), (0, 5)])
def test_stage_links_by_the_overlap_of_shingles(spark, monkeypatch, hot, block):
    """Short texts whose last word differs, a line repeated 2 or 20 times, and a group of near
    copies: components of the pairs whose distinct five-word shingles overlap by 0.8."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 10)))
    texts = []
    for n in [8, 10, 12, 14, 20] * 6:
        words = [word() for _ in range(n)]
        texts += [" ".join([*words[:-1], word()]) for _ in range(2)]
    for _ in range(3):
        words, line = [word() for _ in range(200)], [word() for _ in range(30)]
        texts += [" ".join(words + line * k) for k in (2, 20)]
    base = [word() for _ in range(90)]
    for k in range(25):
        near = list(base)
        near[3 * k] = word()
        texts.append(" ".join(near))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = [x if g == y else g for g in group]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = simhash.near_duplicates(df, dataclasses.replace(simhash.STAGE, hot=hot)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(group))


@pytest.mark.parametrize("how", [simhash.SimHash(), simhash.STAGE])
def test_rows_of_hot_buckets_are_joined_with_their_counts_once(spark, monkeypatch, how):
    """Copies that all differ share buckets; their numbers of blocks come with the bucket's size,
    by rows and by the longs that a cell compares, and no further join on a bucket follows."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "BLOCK_LONGS", 40 * 56)
    rng = np.random.default_rng(14)
    base = [f"w{rng.integers(10**6)}" for _ in range(60)]
    texts = [" ".join([*base[:-1], f"n{k}"]) for k in range(60)]
    kind = type(spark.range(0))
    cells, joins, keep, plain = [], [], simhash._cells, kind.join
    monkeypatch.setattr(simhash, "_cells", lambda rows: cells.append(rows) or keep(rows))
    monkeypatch.setattr(kind, "join", lambda self, other, on=None, *a: joins.append(on) or plain(self, other, on, *a))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = simhash.near_duplicates(df, dataclasses.replace(how, hot=0)).collect()
    assert len(got) == 60 and (not how.exact or {r["component_id"] for r in got} == {0})
    want = cells[0].groupBy("seg", "v").agg(*simhash._blocks(F.size("of")))
    numbers = cells[0].select("seg", "v", "own", "foreign").distinct()
    assert sorted(map(tuple, numbers.collect())) == sorted(map(tuple, want.collect()))
    assert not how.exact or want.agg(F.max("own")).first()[0] > 1
    assert joins.count(["seg", "v"]) == 2  # keys with sizes, and pairs of cool buckets


def test_stage_is_simhash_over_segments():
    """Bits are majorities over the distinct shingles, so they differ as the angle of two texts
    does; and 63 of the bits of the index can't touch all of its segments."""
    how = simhash.STAGE
    rng = np.random.default_rng(13)
    words = [f"w{rng.integers(10**6)}" for _ in range(240)]
    bits = lambda w: np.unpackbits(np.array(simhash.fingerprint(" ".join(w), how)[: how.longs], dtype=">u8").view(np.uint8))
    one = bits(words)
    assert (bits(words * 3)[:1536] != one[:1536]).mean() < 0.06  # repeats count once
    for changed in (4, 12, 30):
        other = list(words)
        for i in range(0, 240, 240 // changed):
            other[i] = f"x{i}"
        a, b = ({tuple(w[i : i + how.words]) for i in range(len(w) - how.words + 1)} for w in (words, other))
        want = np.arccos(len(a & b) / np.sqrt(len(a) * len(b))) / np.pi
        assert abs((bits(other) != one).mean() - want) < 0.03
    segments = simhash._segments(how)
    assert len({(long, shift) for long, shift, _, _ in segments}) == len(segments) == 64 and all(long < how.longs - 1 for long, *_ in segments)
    flips = {(long, shift + int(rng.integers(size))) for long, shift, size, _ in segments[:63]}
    assert len(flips) == 63 and sum(all(not (long == x and shift <= y < shift + size) for x, y in flips) for long, shift, size, _ in segments) == 1


def test_mix_writes_no_places_where_few_rows_are_equal(spark, small, monkeypatch):
    tags = []
    keep = mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, tag: tags.append(tag) or keep(df, tag))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    few = mixing.plan(docs).orderBy("id").collect()
    assert not {"many", "places"} & {*tags}
    assert len(few) == docs.count()


# 5 and 7


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def test_encoder_is_the_library(library, spark, small):
    texts = [t or "" for _, t, *_ in ROWS] + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts += ["a  b", " a", "a ", "a\n b", "a \nb", "\n\n a\n", "don't we'll I'm", "tab\tx y", "é à", "a\u00a0b c", "x\u2003y z", "\x1c a \x85 b", "a <|endoftext|> b"]
    texts += ["a\n\nb", "a\n\n\nb", "x.\nY z", "\n", "\nfoo bar", "foo\n", "foo \nb", "foo\n bar", "don't.\n'tis it's", "é*** ç!!", "a''b word' word's.", "###", "don't!! 'S", "x\n\n y", " ", "a9 9a ½ ª º²", "_a a_b __ A's 'll", "ab'ab. '", "(a) [b]! a.b"]
    got = encoder.encoder(tokenizer_file()).encode(texts)
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:50]


def test_closing_marks_are_pieces_of_their_own(library):
    """Words that commas and full stops close are learnt once, with whatever mark; marks that do
    not stand alone after a letter or digit are encoded as the library does."""
    enc = encoder.Encoder(tokenizer_file())
    texts = ["vorla, vorla. vorla vorla,\nvorla.\n\nvorla 12, 1.5, 7. été, été. été", "vorla.", ", vorla", ". vorla", "vorla ,vorla"]
    odd = ["vorla , x", "vorla., x", "vorla,, x", "(vorla), x", "vorla', x", "vorla'. S", "vorla \n, x", "x\n, vorla", "été« , x", "été», x", "½, x", "a. . b", "._. a", "\u0378, x", "a,\n\n b", "\u0149. a", "º, ª. x", "²,  x", "a,\nb.\n"]
    for t, g in zip([*texts, *odd], enc.encode([*texts, *odd]), strict=True):
        assert np.frombuffer(g, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
    enc = encoder.Encoder(tokenizer_file())
    enc.encode(["x " + "vorla, vorla. " * 3 + "vorla"])
    assert [p for p in enc.rest if "vorla" in p] == ["vorla"]


def test_repeated_pieces_cost_once(library, monkeypatch):
    """A piece is looked up once for all texts of a call, and a run of marks that closes words is
    encoded once whatever the word; texts that are cut and others keep their order."""
    texts = ["x vorla wek vorla", "wek  vorla", "", "vorla wek", "été vorla%%% wek%%% x%%%", "\nvorla\nwek", " ", "\n", "a ", " \x03", "x vorla"] * 3
    enc = encoder.Encoder(tokenizer_file())
    runs, seen, split = [], [], enc.rest.split
    enc.rest.split = lambda text: runs.append(text) or split(text)
    monkeypatch.setattr(encoder._Pieces, "__getitem__", lambda self, piece: seen.append((self is enc.rest, piece)) or dict.__getitem__(self, piece) if piece in self else self.__missing__(piece), raising=False)
    for t, g in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(g, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert runs.count("%%%") == 1
    assert seen.count((True, "vorla")) <= 2  # "vorla%%%" asks for it again


def test_few_texts_are_strings_at_once(spark, monkeypatch, tmp_path):
    """Files are the same however many texts of an Arrow batch become strings at once."""
    rows = [(i // 2, f"vorla {i}, wek. " * (i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = []
    for n in (3, 256):
        monkeypatch.setattr(tokenout, "_TEXTS", n)
        got = tokenout.round_trip(df, tokenizer_file(), out=str(tmp_path / str(n)))
        found.append(sorted(map(tuple, got.collect())))
    assert found[0] == found[1] and len(found[0]) == 40


@pytest.mark.parametrize(("chunk", "overlap"), [(tokencount.CHUNK, tokencount.OVERLAP), (300, 40), (90, 34)])
def test_token_counts(docs, library, chunk, overlap):
    got = tokencount.count_tokens(docs, tokenizer_file(), chunk=chunk, overlap=overlap)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got.collect()) == sorted(
        (str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ROWS
    )


def test_token_counts_empty(empty):
    assert tokencount.count_tokens(empty, tokenizer_file()).count() == 0


def test_token_files_round_trip(docs, empty, library, monkeypatch):
    monkeypatch.setattr(tokenout, "CHUNK_DOCS", 3)
    monkeypatch.setattr(tokenout, "BUCKET_KEYS", 2)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"]), r["n_tokens"], r["ids_crc32"]) for r in tokenout.round_trip(docs, tokenizer_file()).collect())
    at = 0
    for (i, t, *_), r in zip(sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0)), got, strict=True):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert r == ((i is not None, i or 0, at), len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenout.round_trip(empty, tokenizer_file()).count() == 0


def test_a_hot_key_spans_shards(spark, library):
    """A third of the rows has no id; its rows fill several shards in the order of their texts."""
    rows = [(None, f"text number {i}") for i in range(400)] + [(i, f"other {i}") for i in range(800)] + [(3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted((r["start"], r["n_tokens"], r["ids_crc32"], r["doc_id"]) for r in tokenout.round_trip(df, tokenizer_file()).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    encoded = lambda t: np.array([*library.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
    assert Counter((r[3], r[2]) for r in got) == Counter((i, zlib.crc32(encoded(t).tobytes())) for i, t in rows)
    assert [r[0] for r in got] == np.concatenate([[0], np.cumsum([r[1] for r in got])[:-1]]).tolist()
    order = [(i is not None, i or 0) for *_, i in got]
    assert order == sorted(order)


def test_keyed_access(spark, docs, library, tmp_path):
    tokenout.round_trip(docs, tokenizer_file(), out=str(tmp_path))
    got = tokenout.get(spark, str(tmp_path), [1, 9, 11, 10, 999])
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in ROWS if i in (1, 9, 10, 11)}
    assert got == want


def test_perfect_hash_and_unknown_keys():
    codes = tokenout.key_code(np.arange(5000) * 17, np.zeros(5000, dtype=np.int64))
    levels = tokenout.build_mphf(codes)
    assert sorted(tokenout.slots(levels, codes)) == list(range(5000))
    other = tokenout.key_code(np.arange(5000) * 17 + 1, np.zeros(5000, dtype=np.int64))
    at = tokenout.slots(levels, other)
    order = np.empty(5000, dtype=np.int64)
    order[tokenout.slots(levels, codes)] = np.arange(5000)
    same = (at >= 0) & (tokenout._check(codes[order][np.maximum(at, 0)]) == tokenout._check(other))
    assert not same.any()


# 6


def test_edit_embedding_against_single_walks(spark, docs, empty):
    keep = [r for r in ROWS if r[0] is not None and r[0] != 10]
    df = spark.createDataFrame(keep, DOCS)
    got = {r["doc_id"]: r for r in editembed.edited_fingerprints(df).collect()}
    order = sorted(keep, key=lambda r: -r[0])
    assert len(got) == len(keep)
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = (editembed.fingerprints([x])[0] for x in (t, edited, nxt))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a, b)
        assert (r["near_edited"], r["near_next"]) == (editembed.likeness(a, b), editembed.likeness(a, c))
    assert editembed.edited_fingerprints(docs).count() == len(ROWS)
    assert editembed.edited_fingerprints(empty).count() == 0


def test_walk_is_the_defined_one():
    text, moves = "some text of no great length, walked by hand", editembed._moves()
    j, steps = 0, []
    for c in editembed._classes(text):
        steps.append(j)
        j += int(moves[c * editembed.PERIOD + j % editembed.PERIOD])
    assert editembed.walk([editembed._classes(text)])[0].tolist() == [*steps, j]


def brute_print(text):
    """Characters on which the walk stands at the sampled steps, step by step."""
    moves, chars = editembed._moves(), editembed._classes(text)
    j, at = 0, []
    for c in chars:
        wait = int(moves[c * editembed.PERIOD + j % editembed.PERIOD])
        at += [int(c)] * wait
        j += wait
    level = max(0, int(np.ceil(np.log2(max(1, 2 * len(chars)) / editembed.SAMPLES))))
    return level, at


def brute_likeness(a, b):
    (la, xa), (lb, xb) = brute_print(a), brute_print(b)
    steps = [k for k in editembed._sampled(max(la, lb), 1 << 20).tolist() if k < max(len(xa), len(xb))]
    return sum(k < min(len(xa), len(xb)) and xa[k] == xb[k] for k in steps) / len(steps) if steps else 0.0


def test_likeness_by_its_definition():
    rng = np.random.default_rng(7)
    base = "".join(rng.choice(list("abcdefgh ij"), 700))
    texts = [base, base[:350] + "z" + base[351:], base[:500], base * 3, base[::-1], "abc", "abd", base[100:]]
    for a in texts:
        for b in texts:
            if a != b:
                got = editembed.likeness(*editembed.fingerprints([a, b]))
                assert got == pytest.approx(brute_likeness(a, b), abs=1e-6)


@pytest.mark.parametrize("hot", [48, 0])
def test_edit_near_duplicates(spark, monkeypatch, hot):
    monkeypatch.setattr(editembed, "HOT", hot)
    monkeypatch.setattr(editembed, "BLOCK", 5)
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdefghij klmnop"), 800)) for _ in range(8)]
    rows = []
    for i in range(40):
        t = list(base[i % 8])
        for _ in range(i // 8):
            t[rng.integers(len(t))] = rng.choice(["", "zz", "q"])
        rows.append((i, "".join(t)))
    got = editembed.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r["class_id"] == r["doc_id"] % 8 for r in got) and len(got) == 40


BIG = [(2**60 + 1, "one text of some words"), (2**60 + 3, "another text, of other words"), (None, "a third"), (-(2**60) - 1, "fourth")]


def test_large_ids_beside_nulls(spark):
    """No id passes through a floating number."""
    df = spark.createDataFrame(BIG, "doc_id bigint, text string").coalesce(1)
    ids = lambda out: sorted((r[0] for r in out.select("doc_id").collect()), key=str)
    want = sorted((i for i, _ in BIG), key=str)
    labels = spark.createDataFrame([(2**60 + 1, 1, 0), (-(2**60) - 1, 0, 0)], "doc_id bigint, quality int, toxic int")
    path = tokenizer_file()
    for out in (
        editembed.edited_fingerprints(df), tokencount.count_tokens(df, path), tokencount.count_tokens(df, path, chunk=8, overlap=6), tokenout.round_trip(df, path),
        quality.score_documents(df, labels), simhash.near_duplicates(df), sharding.shard_documents(df), mixing.plan(df.withColumn("source", F.lit("s"))).withColumnRenamed("id", "doc_id"),
    ):
        assert ids(out) == want
    order = ["another text, of other words", "one text of some words", "fourth", "a third"]
    got = {r["doc_id"]: r["edited_sha256"] for r in editembed.edited_fingerprints(df, bucket_chars=20).collect()}
    for (i, t), nxt in zip([BIG[1], BIG[0], BIG[3], BIG[2]], [*order[1:], order[0]], strict=True):
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()


# 8


def test_null_and_equal_keys_spread_over_shards(spark):
    rows = [(None, f"{i:020}") for i in range(4000)] + [(1, "the same text")] * 2000
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).toPandas()
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 8 and abs(sums - sums.mean()).max() <= 0.01 * sums.mean() + 21
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_splitters_against_a_full_sort(spark):
    rng = np.random.default_rng(9)
    rows = [(int(p), int(w)) for p, w in zip(rng.integers(0, sharding.SPAN, 3000), rng.integers(1, 500, 3000), strict=True)]
    cuts = sharding.splitters(spark.createDataFrame(rows, "p bigint, size bigint"), 5, tolerance=0.0)
    order = sorted(rows)
    below = np.cumsum([w for _, w in order])
    for i, cut in enumerate(cuts, 1):
        got = sum(w for p, w in rows if p < cut)
        assert abs(got - below[-1] * i // 5) == min(abs(int(x) - below[-1] * i // 5) for x in [0, *below])


def test_shards_of_equal_bytes(spark, docs, empty):
    rng = np.random.default_rng(4)
    rows = [(i, "x" * int(rng.pareto(1.2) * 20)) for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = sharding.shard_documents(df).toPandas()
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 8 and abs(sums - sums.mean()).max() <= max(len(t) for _, t in rows) + 0.01 * sums.mean()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    texts = dict(rows)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id]) + 1 for r in out.itertuples())
    assert sharding.shard_documents(docs).count() == len(ROWS) and sharding.shard_documents(empty).count() == 0


def test_slots_in_many_cells(spark):
    rows = spark.range(3000).select(sharding.place(F.col("id")).alias("p"), F.lit(1).cast("long").alias("size"), "id")
    out = sharding.shard_rows(rows, sharding.splitters(rows, 3), rows_a_cell=50).toPandas().sort_values(["shard", "slot"])
    for _, g in out.groupby("shard"):
        assert g["slot"].tolist() == list(range(len(g))) and g["p"].is_monotonic_increasing


def test_write_shards(docs, tmp_path, spark):
    sharding.write_shards(docs, str(tmp_path / "s"), shards=3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ROWS)


# 9


def brute_tiles(item, doc, least=tiling.MATCH):
    """The textbook loop: all longest matches of unmarked words, marked in order."""
    ma, mb, total = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return total
        n, i, j = best
        ma[i : i + n], mb[j : j + n] = [True] * n, [True] * n
        total += n


def test_tiling_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(60):
        item = [f"w{x}" for x in rng.integers(0, 4, rng.integers(5, 40))]
        doc = [f"w{x}" for x in rng.integers(0, 4, rng.integers(0, 60))]
        block = tiling.Block([(1, " ".join(item))])
        got = tiling.covered(" ".join(doc), block, 0.0)
        share = brute_tiles(item, doc) / len(item)
        assert (got[0][1] if got else 0.0) == pytest.approx(share, abs=1e-6)


def test_repetitive_texts_stay_small():
    import tracemalloc

    for words in (["w"], ["a", "b"]):
        item, text = " ".join(words * (20_000 // len(words))), " ".join(["x", *words * (20_000 // len(words))])
        block = tiling.Block([(1, item)])
        tracemalloc.start()
        got = tiling.covered(text, block, 0.5)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got == [(1, 1.0)] and peak < 300e6


def test_repeated_phrases_are_not_listed_as_pairs():
    """A phrase that returns with other neighbours each time."""
    import time
    import tracemalloc

    phrase = [f"p{i}" for i in range(5)]
    item = [w for i in range(2000) for w in (*phrase, f"i{i}")]
    text = " ".join(w for i in range(4000) for w in (*phrase, f"d{i}"))
    block = tiling.Block([(1, " ".join(item))])
    tracemalloc.start()
    start = time.time()
    got = tiling.covered(text, block, 0.5)
    assert time.time() - start < 20 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert got == [(1, round(5 / 6, 9))]


def test_items_of_equal_words_and_without_id(spark, monkeypatch):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    bench = spark.createDataFrame([(9, a), (2, a.upper() + "!"), (None, a), (None, b), (None, b)], "item_id bigint, text string")
    df = spark.createDataFrame([(1, a), (2, b), (3, a + " " + b)], "doc_id bigint, text string")
    for size in (tiling.BLOCK_WORDS, 10):
        monkeypatch.setattr(tiling, "BLOCK_WORDS", size)
        got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in tiling.with_leaks(df, bench).collect()}
        assert got == {1: [2], 2: [None], 3: [2, None]} or got == {1: [2], 2: [None], 3: [None, 2]}
    assert tiling.decontaminate(df, bench).count() == 0


def test_item_blocks_count_words_of_dense_scripts(spark, monkeypatch):
    monkeypatch.setattr(tiling, "BLOCK_WORDS", 100)
    bench = spark.createDataFrame([(i, "".join(chr(0x4E00 + i * 60 + k) for k in range(60))) for i in range(4)], "item_id bigint, text string")
    assert [len(x) for x in tiling._blocks(bench, "item_id", "text")] == [1, 1, 1, 1]


def test_scripts_without_blanks():
    item = "吾輩は猫である。名前はまだ無い。どこで生れたか頓と見当がつかぬ。"
    block = tiling.Block([(1, item)])
    assert tiling.covered("前置き。" + item[16:] + "間に" + item[:16] + "終わり", block, 0.5)[0][1] > 0.9
    assert tiling.covered("全く別の話をここに書くことにする。", block, 0.5) == []


def test_clashing_columns_pass(spark, docs):
    bench = spark.createDataFrame([(1, "w " * 9)], "item_id bigint, text string")
    clash = docs.select("*", *[F.lit(7).alias(c) for c in ("leaks", "__leaks", "shard", "p", "size", "fp", "h", "id", "stats", "no_id", "bucket")])
    assert tiling.decontaminate(clash, bench).columns == clash.columns and tiling.decontaminate(clash, bench).where("leaks = 7").count() == len(ROWS)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    for out in (
        quality.score_documents(clash, labels), mixing.plan(clash), simhash.near_duplicates(clash), tokencount.count_tokens(clash, tokenizer_file()),
        tokenout.round_trip(clash, tokenizer_file()), editembed.edited_fingerprints(clash), sharding.shard_documents(clash),
    ):
        assert out.count() == len(ROWS)
    assert mixing.mix(clash).where("leaks = 7").count() == mixing.mix(docs).count()


def test_decontamination_finds_reordered_items(spark, docs, empty, monkeypatch):
    item = [f"q{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (4, ""), (None, "x " * 9), (5, " ".join(item))], "item_id bigint, text string")
    texts = ["pad " * 50 + " ".join(item[20:] + ["and"] + item[:20]).upper().replace(" ", ", ") + " pad" * 9, " ".join(item[:15]), None, "", "nothing here " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for size in (tiling.BLOCK_WORDS, 10):
        monkeypatch.setattr(tiling, "BLOCK_WORDS", size)
        got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in tiling.with_leaks(df, bench).collect()}
        assert got == {0: [1], 1: [], 2: [], 3: [], 4: []}
    assert tiling.decontaminate(docs, bench).count() == len(ROWS) and tiling.decontaminate(empty, bench).count() == 0
    assert tiling.decontaminate(df, bench.limit(0)).count() == 5


# 10


@pytest.mark.parametrize("most", [common.MAX_BROADCAST, -1])
def test_site_lines(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MAX_BROADCAST", most)
    rows = [(i, f"https://h.org/{i}", f"menu\nline {i}\nmenu\n{'often' if i < 3 else 'x'}\n") for i in range(6)]
    rows += [(10, "https://few.org/", "menu\nmenu"), (11, None, "menu"), (12, "https://h.org/z", None), (13, "https://h.org/e", "")]
    out = {r["page_id"]: r for r in lines.drop_boilerplate(spark.createDataFrame([(*r, "c") for r in rows], "page_id bigint, url string, html string, host string")).collect()}
    assert out[0]["kept_text"] == "line 0\noften\n" and out[0]["n_dropped"] == 2 and out[0]["n_lines"] == 5
    assert out[10]["kept_text"] == "menu\nmenu" and out[11]["n_dropped"] == 0 and (out[12]["n_lines"], out[12]["kept_text"]) == (0, "")
    assert len(out) == len(rows)


def test_empty_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert lines.drop_boilerplate(pages).count() == 0
    assert urlfilter.apply_rules(pages, urlfilter.rules_table(spark)).count() == 0
    assert editembed.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


# queries and pipeline


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want, got = con.sql(SQL[name]).df(), QUERIES[name](spark, small).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    numbers = [c for c in got.columns if got[c].dtype.kind in "iuf"]
    got, want = got.astype({c: float for c in numbers}), want.astype({c: float for c in numbers})
    rows = lambda df: Counter(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
    assert rows(want) == rows(got)


def test_pipeline_against_brute_force(spark, tmp_path, small):
    """Copies, leaks and bad texts that are planted go, all else stays until the mix."""
    import corpus_pipeline

    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 10))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab, n)) + "."
    bench = [(i, text(40)) for i in range(5)]
    good = [[i, text(int(rng.integers(60, 200))), "en", f"s{i % 3}", 0] for i in range(120)]
    near = []
    for i in range(10):
        w = good[i][1].split(" ")
        w[len(w) // 2] = "changed"
        near.append([200 + i, " ".join(w), "en", "s1", 0])
    same = [[300 + i, good[20 + i][1], "en", "s2", 0] for i in range(10)]
    leaks = [[400 + i, text(30) + " " + bench[i][1] + " " + text(30), "en", "s0", 0] for i in range(5)]
    bad = [[500 + i, " ".join(w + "###" for w in text(80).split()), "en", "s0", 0] for i in range(40)]
    docs = spark.createDataFrame(good + near + same + leaks + bad + [[None, None, None, None, None]], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad[:30]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = {r[0] for r in good + near + same + leaks + bad} | {None}
    # the row of nulls is judged like any other: an empty text has no quality
    gone = [{r[0] for r in bad} | {None}, {r[0] for r in near + same}, {r[0] for r in leaks}]
    for (name, stage), out in zip(corpus_pipeline.STAGES[:3], gone, strict=False):
        kept = corpus_pipeline.materialize(stage(spark, kept, str(tmp_path)), "t")
        ids -= out
        assert kept.columns == corpus_pipeline.COLUMNS
        assert {r[0] for r in kept.select("doc_id").collect()} == ids and kept.count() == len(ids), name
    mixed = corpus_pipeline.mix_sources(spark, kept, str(tmp_path))
    plan = mixing.plan(kept).select("id", F.size("draws").alias("n")).where("n > 0").collect()
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["id"]: r["n"] for r in plan})
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == mixed.count()


def test_stages_tell_rows_of_one_id_apart(spark, tmp_path):
    """Repeated and null ids with other texts, and columns that clash with those of the stages."""
    import corpus_pipeline

    rng = np.random.default_rng(12)
    t = [" ".join(f"{w}{i}" for w in rng.choice(list("abcdefghij"), 60)) for i in range(9)]
    near = t[1].split(" ")
    near[30] = "changed"
    rows = [(3, t[1]), (5, t[2]), (5, t[1]), (7, t[4]), (7, t[5]), (None, t[6]), (None, t[6]), (None, t[1]), (None, t[7]), (1, None), (1, None), (2, ""), (7, t[4]), (9, " ".join(near))]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS)
    kept = corpus_pipeline.drop_near_copies(spark, df.withColumns({"row": F.lit(1), "a": F.lit(2), "fp": F.lit(3)}), "")
    assert kept.columns == corpus_pipeline.COLUMNS
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(3, t[1]), (5, t[2]), (7, t[4]), (7, t[5]), (None, t[6]), (None, t[7]), (1, None), (1, None), (2, "")])
    good, bad = [" ".join(rng.choice(t[k].split(" "), 50)) for k in range(8) for _ in range(20)], ["### $$$ " * 40 + str(i) for i in range(60)]
    docs = [(i % 50, x) for i, x in enumerate(good)] + [(i % 50, x) for i, x in enumerate(bad)] + [(None, good[0]), (None, bad[0])]
    labels = [(1000 + i, 1, 0) for i in range(len(good))] + [(2000 + i, 0, 0) for i in range(len(bad))]
    marked = [(1000 + i, x) for i, x in enumerate(good)] + [(2000 + i, x) for i, x in enumerate(bad)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in docs + marked], DOCS)
    kept = corpus_pipeline.keep_quality(spark, df.withColumns({"a": F.lit(2), "predicted": F.lit(3)}), str(tmp_path))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(x for x in docs + marked if "###" not in x[1])


def test_mix_takes_what_the_plan_says_of_each_source(spark, tmp_path):
    rows = [(1, "one two three", "en", "a", 1), (1, "one two three", "en", "b", 1), (1, "one two three", None, "a", 1), (1, "one two three", "en", None, 1)] * 2
    rows += [(i, f"w{i} " * (1 + i % 7), "en", "ab"[i % 2], i) for i in range(2, 60)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    want = Counter()
    for r in mixing.plan(df).select("source", F.size("draws").alias("n")).collect():
        want[r["source"]] += r["n"]
    mixed = mixing.mix(df)
    assert Counter(r["source"] for r in mixed.collect()) == +want
    mixing.write_mix(mixed, str(tmp_path / "mix"), files_a_shard=2)
    back = spark.read.parquet(str(tmp_path / "mix"))
    assert Counter(map(tuple, back.select(*df.columns, "__shard").collect())) == Counter(map(tuple, mixed.select(*df.columns, "__shard").collect()))


def test_stages_on_empty_tables(spark, empty, small):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0


def test_tokenizer_file_is_a_parameter(tmp_path, library):
    path = tmp_path / "t.json"
    conf = json.loads(open(tokenizer_file(), encoding="utf-8").read())
    path.write_text(json.dumps(conf), encoding="utf-8")
    assert encoder.Encoder(str(path)).encode(["a b"]) == encoder.Encoder(tokenizer_file()).encode(["a b"])
