"""Golden values, equivalences between operators, and properties."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import distances as D
from seqloom.functions import tokens as T
from seqloom.operators import codecs, cooc, frames, grams, graph, linalg, mixture, paths, series, transport, weight
from seqloom.operators import vocab as V
from seqloom.operators.windows import WindowSpec, expand, geometric, harmonic, kernel_of, variable_radii
from seqloom.plans import estimators as E
from seqloom.plans.tables import numbered
from seqloom.sources import sequences as S

# Fixed values, down to BPE: sequences for which results are published, and the results.
NUMBERS = [[1, 3, 1, 4, 2], [2, 1, 2, 3, 4, 1, 2, 1, 3, 2, 4], [4, 1, 1, 3, 2, 4, 2], [1, 2, 2, 1, 2, 1, 3, 4, 3, 2, 4], [3, 4, 2, 1, 3, 1, 4, 4, 1, 3, 2], [2, 1, 3, 1, 4, 4, 1, 4, 1, 3, 2, 4]]
TEXTS = [
    "foo pok foo wer bar", "", "bar foo bar pok wer foo bar foo pok bar wer", "wer foo foo pok bar wer bar",
    "foo bar bar foo bar foo pok wer pok bar wer", "pok wer bar foo pok foo wer wer foo pok bar", "bar foo pok foo wer wer foo wer foo pok bar wer",
]
PERMUTED = ["wer pok", "bar pok", "foo pok wer"]
GRAMS = ["wer pok wer", "bar pok wer", "foo pok wer"]
SUMMARIES = ["foo:2.0,wer:1.0", None, "bar:4.0,foo:3.0", "wer:2.0,foo:2.0", "bar:4.0,foo:3.0", "wer:3.0,pok:3.0", "wer:4.0,foo:4.0"]
HYPEREDGES = [
    [555, 878, 1833, 5590, 8518], [619, 1226, 3908, 6558], [172, 1126, 1237, 6877], [560, 1244, 4174, 5089, 9558], [95, 138, 962, 1011, 3440],
    [695, 2118, 3161], [79, 2821, 5916, 6905], [133, 5350, 8367], [21, 539, 1031, 3412], [289, 776, 2730, 4253, 4333, 5452, 6109],
    [2205, 2399, 4198, 8700, 8894], [152, 279, 4530, 9108], [753, 780, 970, 1439, 3532], [399, 481, 1062, 1213, 1251, 1866, 3046, 4674, 6768, 7742, 8673],
    [27, 1519, 8966], [228, 697, 2358], [1100, 1282, 4249, 5072, 6018, 8089, 8481], [88, 167, 951, 974, 2051, 2622, 6244, 9674], [194, 2269, 2343], [3539, 4141, 4370, 9597],
]
HELLINGER = [((0.0, 0.0), (0.0, 0.0), 0.0), ((0.0, 0.0), (1.0, 0.0), 1.0), ((0.5, 0.5), (0.5, 0.5), 0.0), ((0.5, 0.5), (1.0, 0.0), 0.5411961001461969), ((0.1, 0.9), (1.0, 0.0), 0.8269052146305295)]
BPE = (["asdfqwerty", "asdf", "qwzxasdfcv"], ["asdf qw e r t y", "asdf", "qw z x asdf c v"])


@pytest.fixture(scope="module")
def seqs(spark):
    def make(lists):
        rows = [(i, x.split() if isinstance(x, str) else x) for i, x in enumerate(lists)]
        kind = "int" if lists and not isinstance(lists[0], str) else "string"
        return spark.createDataFrame(rows, f"doc_id bigint, tokens array<{kind}>")

    return make


def cells(df, *keys):
    return {tuple(r[k] for k in keys): round(r["value"], 6) for r in df.collect()}


def test_two_grams_of_the_golden_texts(seqs):
    model = E.NgramVectorizer(ngram_size=2).fit(seqs(TEXTS))
    out = model.transform(seqs(TEXTS))
    assert model.columns.count() == 15 and out.count() == 43


def test_document_bounds(seqs):
    rows = S.tokens_of_arrays(seqs(PERMUTED))
    keep = lambda **k: [r["token"] for r in V.vocabulary(rows, V.Prune(**k), 3).orderBy("idx").collect()]
    assert keep(min_document_occurrences=2) == keep(min_document_frequency=0.6) == ["pok", "wer"]
    assert keep(max_document_occurrences=1) == keep(max_document_frequency=0.4) == ["bar", "foo"]
    assert keep(excluded=("pok",)) == ["bar", "foo", "wer"] and keep(excluded_pattern="b.*|wer") == ["foo", "pok"]
    assert [r["token"] for r in V.vocabulary(S.tokens_of_arrays(seqs(NUMBERS)), V.Prune(max_unique=2)).orderBy("idx").collect()] == [1, 2]
    with pytest.raises(ValueError, match="empty"):
        V.require_tokens(V.vocabulary(rows, V.Prune(min_frequency=1.0)))
    with pytest.raises(ValueError, match="documents"):
        V.vocabulary(rows, V.Prune(min_document_frequency=0.1))


def test_mask_keeps_positions(seqs):
    rows = S.tokens_of_arrays(seqs(PERMUTED))
    vocab = V.vocabulary(rows, V.Prune(min_document_occurrences=2))
    got = {(r["doc_id"], r["pos"]): r["idx"] for r in V.encode(rows, vocab, mask="?").collect()}
    assert got == {(0, 0): 1, (0, 1): 0, (1, 0): 2, (1, 1): 0, (2, 0): 2, (2, 1): 0, (2, 2): 1}
    assert {(r["doc_id"], r["pos"]): r["idx"] for r in V.encode(rows, vocab).collect()} == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (2, 0): 0, (2, 1): 1}


def test_skip_grams_with_bounds(seqs):
    fit = lambda **k: E.SkipgramVectorizer(rules=V.Prune(**k)).fit_transform(seqs(PERMUTED)).collect()
    assert {(r["row_id"], r["value"]) for r in fit(max_document_occurrences=2)} == {(2, 1.0)}
    assert sorted((r["row_id"], r["col_id"]) for r in fit(min_document_occurrences=2)) == [(0, 1), (2, 0)]


def test_merged_models_equal_a_model_of_all(seqs, spark):
    a, b = seqs(TEXTS[:3]), seqs(TEXTS).where("doc_id >= 3")
    both = E.NgramVectorizer().fit(a) + E.NgramVectorizer().fit(b)
    whole = E.NgramVectorizer().fit(seqs(TEXTS))
    assert cells(both.transform(seqs(TEXTS)), "row_id", "col_id") == cells(whole.transform(seqs(TEXTS)), "row_id", "col_id")
    with pytest.raises(NotImplementedError):
        E.NgramVectorizer(ngram_size=2).fit(a) + E.NgramVectorizer(ngram_size=2).fit(b)


def test_cooccurrence_cells(seqs):
    rows = S.tokens_of_arrays(seqs(NUMBERS))
    vocab, out = cooc.cooccurrence(rows, [WindowSpec("after", 1)], normalize=False)
    got = cells(out, "row_id", "c")
    assert got[0, 2] == 8 and got[1, 0] == 6
    model = E.CooccurrenceVectorizer(window_radii=(1,), normalize_windows=False).fit(seqs(TEXTS))
    named = cells(model.labelled(seqs(TEXTS)), "row_label", "col_label")
    assert named["pok", "pre_0_wer"] == 1 and len({k[1] for k in named}) == 8


def test_radii_add_up(seqs):
    rows = S.tokens_of_arrays(seqs(TEXTS))
    run = lambda r, k: cells(cooc.cooccurrence(rows, [WindowSpec("after", r, k)], normalize=False)[1], "row_id", "c")
    one, two, shifted = run(1, harmonic), run(2, harmonic), run(2, kernel_of("harmonic", offset=1))
    assert two == {k: round(one.get(k, 0) + shifted.get(k, 0), 6) for k in {*one, *shifted}}


def test_variable_radii_are_not_capped(spark, tmp_path):
    from seqloom.plans.queries import QUERIES

    words = ["a"] * 100 + list("bcdefg") + ["a"] * 100
    spark.createDataFrame([(i, " ".join(words)) for i in range(20)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    names = sorted(set(words))
    f = {w: words.count(w) / len(words) for w in names}
    norm = sum(x**0.75 for x in f.values())
    radius = {w: max(1, round(x**-0.25 / norm * 2)) for w, x in f.items()}
    want = {}
    for i, w in enumerate(words):
        for c in words[i + 1 : i + 1 + radius[w]]:
            k = names.index(w), names.index(c)
            want[k] = want.get(k, 0) + 20
    got = QUERIES["cooc_variable_radius"](spark, str(tmp_path)).collect()
    assert max(radius.values()) > 4 and {(r["row_id"], r["col_id"]): r["value"] for r in got} == want


def test_before_is_the_transpose_of_after(seqs):
    rows = S.tokens_of_arrays(seqs(TEXTS))
    run = lambda o: cells(cooc.cooccurrence(rows, [WindowSpec(o, 3)], normalize=False)[1], "row_id", "c")
    assert run("before") == {(b, a): v for (a, b), v in run("after").items()}


def test_timed_and_multiset_equal_plain_on_unit_steps(seqs, spark):
    data = seqs([NUMBERS[0], NUMBERS[2]])
    rows = S.tokens_of_arrays(data)
    vocab = V.vocabulary(rows)
    known = V.encode(rows, vocab)
    windows = [WindowSpec("after", 2, geometric(0.9))]
    plain = cells(cooc.cells(cooc.exploded(cooc.contexts(known, windows, False))), "row_id", "c")
    from seqloom.operators.windows import timed_geometric

    timed = known.withColumn("t", F.col("pos") * 1.0)
    assert plain == cells(cooc.cells(cooc.exploded(cooc.timed_contexts(timed, windows, timed_geometric(0.9), normalize=False))), "row_id", "c")
    sets = known.select("doc_id", F.col("pos").alias("set_pos"), F.lit(0).alias("item_pos"), "idx")
    assert plain == cells(cooc.cells(cooc.multiset_pairs(sets, windows)), "row_id", "c")


def test_hyperedges(spark):
    df = spark.createDataFrame([(0, HYPEREDGES)], "doc_id bigint, sets array<array<int>>")
    rows = S.multisets_of_arrays(df)
    vocab = V.vocabulary(rows)
    known = rows.join(vocab.select("token", "idx"), "token")
    out = cooc.cells(cooc.multiset_pairs(known, [WindowSpec("before", 0)]))
    assert vocab.count() == 97 and out.count() == 452
    for rounds in (1, 2):
        assert E.MultiSetCooccurrenceVectorizer(0, "before", normalize_windows=False, n_iter=rounds).fit_transform(df).count() == 452


def test_ngram_rows(seqs):
    model = E.CooccurrenceVectorizer(variant="ngram").fit(seqs(GRAMS))
    got = cells(model.labelled(seqs(GRAMS)), "row_label", "col_label")
    assert got == {("bar_pok", "post_0_wer"): 1, ("foo_pok", "post_0_wer"): 1, ("pok_wer", "pre_0_bar"): 1, ("pok_wer", "pre_0_foo"): 1, ("pok_wer", "pre_0_wer"): 1, ("wer_pok", "post_0_wer"): 1}


def test_em_keeps_columns_normalised(seqs):
    rows = S.tokens_of_arrays(seqs(TEXTS))
    out = cooc.cooccurrence(rows, [WindowSpec("after", 3)], rounds=2)[1]
    sums = out.groupBy("c").agg(F.sum("value").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums)
    few = cooc.cooccurrence(rows, [WindowSpec("after", 3)], epsilon=0.3, normalize=False)[1]
    assert few.count() < out.count() and few.agg(F.min("value")).first()[0] >= 0.3


def tree(spark, labels):
    nodes = [(t, i, x) for t, row in enumerate(labels) for i, x in enumerate(row)]
    edges = [(t, i, i + 1, 1.0) for t, row in enumerate(labels) for i in range(len(row) - 1)]
    return spark.createDataFrame(nodes, "tree_id int, node_id int, label string"), spark.createDataFrame(edges, "tree_id int, src int, dst int, weight double")


def test_trees(spark, seqs):
    nodes, edges = tree(spark, ["abcd", "bcde"])
    got = cells(graph.tree_cooccurrence(nodes, edges, 2, orientation="after"), "row_label", "col_label")
    assert got == {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 2, ("b", "d"): 2, ("c", "d"): 2, ("c", "e"): 1, ("d", "e"): 1}
    nodes, edges = tree(spark, ["abac"])
    got = cells(graph.tree_cooccurrence(nodes, edges, 2, orientation="after"), "row_label", "col_label")
    assert got == {("a", "a"): 1, ("a", "b"): 1, ("a", "c"): 1, ("b", "a"): 1, ("b", "c"): 1}
    nodes, edges = tree(spark, [x.split() for x in PERMUTED])
    same = cooc.cooccurrence(S.tokens_of_arrays(seqs(PERMUTED)), [WindowSpec("after", 2)], normalize=False)
    names = {r["idx"]: r["token"] for r in same[0].collect()}
    plain = {(names[a], names[b]): v for (a, b), v in cells(same[1], "row_id", "c").items()}
    assert plain == cells(graph.tree_cooccurrence(nodes, edges, 2, orientation="after"), "row_label", "col_label")
    model = E.LabelledTreeCooccurrenceVectorizer(nodes, 2, rules=V.Prune(min_document_occurrences=2), orientation="after").fit(edges)
    assert cells(model.transform(edges), "row_label", "col_label") == {("pok", "wer"): 1, ("wer", "pok"): 1}
    with pytest.raises(ValueError, match="orientation"):
        graph.tree_cooccurrence(nodes, edges, 2, orientation="sideways")


def test_splice_bridges_chains(spark):
    nodes, edges = tree(spark, ["axxbxc"])
    keep = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    got = {(r["src"], r["dst"]): r["weight"] for r in graph.splice(nodes, edges, keep)[1].collect()}
    assert got == {(0, 3): 1.0, (3, 5): 1.0}


def test_edge_lists(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 3.0), ("d", "b", 4.0), ("d", "c", 8.0)], "row_label string, col_label string, value double")
    out = graph.edge_matrix(edges)
    assert {r["row_id"]: r["value"] for r in out.where("col_label = 'c'").collect()} == {1: 2.0, 3: 8.0}
    rows = spark.createDataFrame([("a", 0), ("d", 1)], "label string, idx bigint")
    assert {r["col_id"]: r["value"] for r in graph.edge_matrix(edges, rows).where("row_id = 1").collect()} == {0: 4.0, 1: 8.0}
    joint = graph.edge_matrix(edges, joint=True)
    assert cells(joint, "row_id", "col_id") == {(0, 1): 1, (1, 2): 2, (2, 3): 3, (3, 1): 4, (3, 2): 8}
    with pytest.raises(ValueError, match="missing"):
        S.edge_list(edges, "row_label", "nothing", "value")


def test_categorical_lists(spark):
    df = spark.createDataFrame([("one", "foo", "x", 0), ("two", "bar", "k", 1), ("one", "pok", "c", 2), ("two", "bar", "d", 3), ("two", None, None, 4)], "id string, A string, B string, n int")
    run = lambda *a, **k: {r["id"]: r["tokens"] for r in frames.categorical_lists(df, "id", *a, "n", **k).collect()}
    assert run(["A"]) == {"one": ["foo", "pok"], "two": ["bar", "bar"]} and run(["A"], unique=True)["two"] == ["bar"]
    assert run(["A", "B"], with_names=True)["one"] == ["A:foo", "A:pok", "B:x", "B:c"]
    got = [r[0] for r in df.orderBy("n").select(T.row_tokens(["A", "B"], df)).collect()]
    assert got[0] == ["A:foo", "B:x"] and got[4] == []
    with pytest.raises(ValueError, match="unknown"):
        frames.categorical_lists(df, "id", ["Z"], "n")


def test_summaries(seqs):
    columns, m = grams.ngram_counts(S.tokens_of_arrays(seqs(TEXTS)))
    top = linalg.summarize(m, columns.withColumn("label", F.array_join("label", "")), 2)
    got = {r["row_id"]: r["summary"] for r in linalg.summary_strings(top, with_values=True).collect()}
    assert [got.get(i) for i in range(7)] == SUMMARIES


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def one(spark, c):
    return spark.range(1).select(c).first()[0]


@pytest.mark.parametrize(("x", "y", "want"), HELLINGER)
def test_hellinger(spark, x, y, want):
    assert one(spark, D.hellinger(arr(*x), arr(*y))) == pytest.approx(want)


def test_distances_against_numpy(spark):
    rng = np.random.default_rng(0)
    for _ in range(5):
        x, y = rng.random(12), rng.random(12)
        p, q = x / x.sum(), y / y.sum()
        h, tv = one(spark, D.hellinger(arr(*x), arr(*y))), one(spark, D.total_variation(arr(*x), arr(*y)))
        assert h * h <= tv + 1e-9 <= math.sqrt(2) * h + 2e-9 and tv == pytest.approx(abs(p - q).sum() / 2)
        m = (p + q) / 2
        assert one(spark, D.jensen_shannon(arr(*x), arr(*y))) == pytest.approx((p * np.log(p / m) + q * np.log(q / m)).sum() / 2, abs=1e-8)
        assert one(spark, D.symmetric_kl(arr(*x), arr(*y))) == pytest.approx(((p - q) * np.log(p / q)).sum(), abs=1e-7)
        gap = np.cumsum(p - q)
        assert one(spark, D.kantorovich(arr(*x), arr(*y), 3)) == pytest.approx((abs(gap) ** 3).sum() ** (1 / 3))
        assert one(spark, D.circular_kantorovich(arr(*x), arr(*y))) == pytest.approx(abs(gap - np.median(gap)).sum())
    with pytest.raises(ValueError):
        D.kantorovich(arr(1), arr(1), 0)


def test_sparse_arithmetic(spark):
    a = spark.createDataFrame([(0, 1, 2.0), (0, 3, 1.0)], "pair int, col_id int, value double")
    b = spark.createDataFrame([(0, 1, -2.0), (0, 4, 5.0)], "pair int, col_id int, value double")
    assert cells(D.sparse_sum(a, b), "col_id") == {(3,): 1, (4,): 5} and cells(D.sparse_sum(a, b, -1), "col_id") == {(1,): 4, (3,): 1, (4,): -5}
    assert cells(D.sparse_product(a, b), "col_id") == {(1,): -4}


def long(spark, values):
    return spark.createDataFrame([(s, i, float(x)) for s, row in enumerate(values) for i, x in enumerate(row)], "series_id int, pos int, x double")


def test_sliding_windows(spark):
    rng = np.random.default_rng(1)
    data = [rng.random(23), rng.random(9), rng.random(3)]
    got = {(r["series_id"], r["start"]): r["values"] for r in series.apply_kernel(series.sliding_windows(long(spark, data), 5, 2), series.fold([lambda n: series.differences(n, 0, 1, 1), series.averaging], 5)).collect()}
    for s, row in enumerate(data):
        for i in range(0, len(row) - 4, 2):
            assert got[s, i] == pytest.approx([np.diff(row[i : i + 5]).mean()])
    assert len(got) == 10 + 3
    f = series.apply_function(series.sliding_windows(long(spark, data[:1]), 5), lambda w: w.max()).collect()
    assert {round(r["values"][0], 9) for r in f} == {round(max(data[0][i : i + 5]), 9) for i in range(19)}
    assert series.position_velocity(4, 2)[0] == [0, 0, 1, 0] and series.position_velocity(4, 2)[1] == [0, -1, 1, 0]
    with pytest.raises(ValueError):
        series.weighted([1.0], 2)


def test_changepoint_is_found(spark):
    rng = np.random.default_rng(7)
    x = rng.poisson(0.75, 100)
    x[40] = 10
    rows = series.count_changepoints(long(spark, [x]), 10).collect()
    best = max(rows, key=lambda r: r["score"])
    assert best["start"] + 9 == 40


def test_histograms(spark):
    rng = np.random.default_rng(2)
    data = [rng.poisson(5, n) for n in (30, 120, 64)]
    v = long(spark, data)
    for bins in (series.uniform_bins(v, 20), series.mass_bins(v, 5), series.quantile_bins(v, 4)):
        got = series.histogram(v, bins).groupBy("series_id").agg(F.sum("n").alias("n")).collect()
        assert {r["series_id"]: r["n"] for r in got} == {0: 30, 1: 120, 2: 64}
    model = E.HistogramVectorizer(20, append_outlier_bins=True).fit(v)
    out = {r["bin"]: r["n"] for r in model.transform(long(spark, [[-1, -1, -1, 150]])).collect()}
    assert len(out) == 22 and out[0] == 3 and out[21] == 1


def test_densities(spark):
    v = long(spark, [[1.0, 2.0, 4.0], [3.0]])
    model = E.KDEVectorizer(bandwidth=0.5, n_components=4).fit(v)
    got = {(r["series_id"], r["g"]): r["density"] for r in model.transform(v).collect()}
    want = np.exp(-0.5 * ((2.0 - np.array([1, 2, 4])) / 0.5) ** 2).mean() / (0.5 * math.sqrt(2 * math.pi))
    assert got[0, 1] == pytest.approx(want) and len(got) == 8
    assert series.jackknife_bandwidth(v) > 0


COUNTS = [[1, 2, 3], [4, 5, 6], [7, 8, 9]]


def coo(spark, m):
    return spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(m) for j, x in enumerate(row) if x], "row_id bigint, col_id bigint, value double")


@pytest.mark.parametrize("approximate", [False, True])
def test_information_weights(spark, approximate):
    m = np.array([[1, 2, 0], [4, 0, 6], [0, 8, 9.0]])
    got = {r["col_id"]: r["weight"] for r in weight.information_weights(coo(spark, m), 0.1, approximate).collect()}
    p = m.sum(1) / m.sum()
    for j in range(3):
        n = m[:, j].sum() + 0.1
        c = (0.1 / n) * math.log(0.1 / n)
        o = (m[:, j] + 0.1 * p) / n
        seen = m[:, j] > 0
        rest = c * (3 - seen.sum()) * p.mean() if approximate else c * p[~seen].sum()
        assert got[j] == pytest.approx((o[seen] * np.log(o[seen] / p[seen])).sum() + rest)
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "row_id bigint, label int")
    assert E.InformationWeightTransformer(labels=labels).fit_transform(coo(spark, COUNTS)).count() == 9


def test_row_denoising(spark):
    rng = np.random.default_rng(3)
    background = rng.integers(1, 5, 30)
    rows = [background * 3 + (np.arange(30) == i) * 200 for i in range(6)]
    out = E.RowDenoisingTransformer().fit_transform(coo(spark, rows)).toPandas()
    for i in range(6):
        mine = out[out["row_id"] == i].set_index("col_id")["value"]
        assert mine.idxmax() == i and mine[i] / mine.sum() > 200 / (background.sum() * 3 + 200)
    assert out.groupby("row_id")["value"].sum().max() <= max(r.sum() for r in rows)


def test_svd_and_compression(spark):
    rng = np.random.default_rng(4)
    m = rng.integers(1, 9, (20, 6)).astype(float)
    f = linalg.svd(coo(spark, m), 6, 3)
    assert f.s == pytest.approx(np.linalg.svd(m)[1][:3]) and (f.v[np.abs(f.v).argmax(0), range(3)] > 0).all()
    rows = linalg.project(coo(spark, m), f).orderBy("row_id").toPandas()
    got = np.stack(rows["embedding"])
    assert got @ np.diag(np.sqrt(f.s)) == pytest.approx(m @ f.v)
    model = E.CountFeatureCompressionTransformer(3).fit(coo(spark, m))
    assert np.stack(model.transform(coo(spark, m)).orderBy("row_id").toPandas()["embedding"]) == pytest.approx(np.stack(linalg.compress_counts(coo(spark, m), 6, 3)[1].orderBy("row_id").toPandas()["embedding"]), abs=1e-6)
    with pytest.raises(ValueError):
        linalg.compress_counts(coo(spark, -m), 6, 3)


@pytest.mark.parametrize("bound", [linalg.BROADCAST_BYTES, 0])
def test_svd_against_numpy(spark, monkeypatch, bound):
    """Vectors in a broadcast array and in tables."""
    monkeypatch.setattr(linalg, "BROADCAST_BYTES", bound)
    rng = np.random.default_rng(4)
    m = rng.random((40, 12)) * (rng.random((40, 12)) < 0.4) * np.arange(1, 13) ** 2
    f = linalg.svd(coo(spark, m), 12, 4, n_iter=8, oversample=4)
    u, s, vt = np.linalg.svd(m)
    assert f.s == pytest.approx(s[:4], rel=1e-6)
    rows = linalg.project(coo(spark, m), f).toPandas()
    got = np.zeros((40, 4))
    got[rows["row_id"]] = np.stack(rows["embedding"])
    want = u[:, :4] * np.sqrt(s[:4])
    assert got @ got.T == pytest.approx(want @ want.T, abs=1e-5)


def test_options_of_windows_and_masks(seqs, spark):
    rows = S.tokens_of_arrays(seqs(TEXTS))
    vocab = V.vocabulary(rows)
    # variable radii of two windows, one of them a callable
    twice = lambda v, size: v.select("idx", F.when(F.col("idx") == 0, 2 * size).otherwise(size).alias("radius"))
    model = E.CooccurrenceVectorizer((2, 1), ("after", "before"), ("flat", "harmonic"), window_functions=("variable", twice), normalize_windows=False).fit(seqs(TEXTS))
    radii = {r["idx"]: r["radius"] for r in variable_radii(vocab, 2).collect()}
    idx = {r["token"]: r["idx"] for r in vocab.collect()}
    want: dict = {}
    for text in TEXTS:
        t = [idx[w] for w in text.split()]
        for i, a in enumerate(t):
            for j, b in enumerate(t):
                if 0 < j - i <= radii[a]:
                    want[a, 0, b] = want.get((a, 0, b), 0) + 1
                if 0 < i - j <= (2 if a == 0 else 1):
                    want[a, 1, b] = want.get((a, 1, b), 0) + 1 / (i - j)
    assert cells(model.transform(seqs(TEXTS)), "row_id", "w", "c") == pytest.approx(want)
    with pytest.raises(ValueError):
        E.CooccurrenceVectorizer(window_functions=("odd",)).fit(seqs(TEXTS))
    # a dictionary fixes the order, a mask keeps places, and its own cells count unless nullified
    given = {"token_dictionary": ["wer", "foo"], "normalize_windows": False, "orientations": ("after",), "window_radii": (1,)}
    plain = E.CooccurrenceVectorizer(**given, mask="<m>", nullify_mask=True).fit(seqs(PERMUTED)).transform(seqs(PERMUTED))
    assert cells(plain, "row_id", "c") == {}
    masked = E.CooccurrenceVectorizer(**given, mask="<m>").fit(seqs(PERMUTED))
    assert {(r["row_label"], r["col_label"]) for r in masked.labelled(seqs(PERMUTED)).collect()} == {("wer", "post_0_<m>"), ("foo", "post_0_<m>"), ("<m>", "post_0_<m>"), ("<m>", "post_0_wer")}
    skips = E.SkipgramVectorizer(window_radius=2, token_dictionary=["foo", "wer"], mask="<m>").fit(seqs(PERMUTED))
    assert [(r["head"], r["tail"]) for r in skips.columns.collect()] == [(0, 1)] and skips.transform(seqs(PERMUTED)).count() == 1
    own = E.SkipgramVectorizer(window_radius=1, window_function="variable").fit(seqs(TEXTS))
    assert own.radius == max(r["radius"] for r in variable_radii(vocab, 1).collect())
    grams_ = E.NgramVectorizer(2, token_dictionary=["pok", "wer"], ngram_dictionary=[("wer", "pok"), ("<m>", "pok")], mask="<m>").fit(seqs(PERMUTED))
    assert cells(grams_.transform(seqs(PERMUTED)), "row_id", "col_id") == {(0, 0): 1, (1, 1): 1, (2, 1): 1}
    none = E.NgramVectorizer(2, mask="<m>", nullify_mask=True, token_dictionary=["pok", "wer"]).fit(seqs(PERMUTED))
    assert sorted(tuple(r["label"]) for r in none.columns.collect()) == [("pok", "wer"), ("wer", "pok")]


def test_timed_windows_with_kernels_of_their_own(spark):
    rows = spark.createDataFrame([(0, p, t, float(x)) for p, (t, x) in enumerate([("a", 0), ("b", 1), ("a", 3), ("c", 4)])], "doc_id int, pos int, token string, t double")
    model = E.CooccurrenceVectorizer((1, 2), ("after",), ("flat", "geometric"), ({}, {"power": 0.5}), variant="timed", normalize_windows=False).fit(rows)
    got = cells(model.transform(rows), "row_id", "w", "c")
    gap = 4 / 3
    assert got == pytest.approx({(0, 0, 1): 1, (1, 0, 0): 1, (0, 0, 2): 1, (0, 1, 1): 0.5 ** (1 / gap), (0, 1, 0): 0.5 ** (3 / gap), (1, 1, 0): 0.5 ** (2 / gap), (1, 1, 2): 0.5 ** (3 / gap), (0, 1, 2): 0.5 ** (1 / gap)}, abs=1e-5)


def test_numbering_by_ranges(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 501).alias("a"), (F.col("id") % 3).alias("b")).repartition(5)
    rows = sorted((r["a"], r["b"], r["idx"]) for r in numbered(df, "a", "b").collect())
    assert [r[2] for r in rows] == list(range(500))
    assert numbered(df.limit(0), "a").count() == 0


def test_pairwise_distances(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(9, 3)), rng.normal(size=(4, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
    got = np.stack(transport.pairwise(df, y, "euclidean", block=2).orderBy("id").toPandas()["distances"])
    assert got == pytest.approx(np.linalg.norm(x[:, None] - y[None], axis=2))


def test_kernels_of_densities_and_bandwidth(spark):
    values = [[0.0, 0.4, 1.1, 3.0], [2.0, 2.2]]
    df = long(spark, values)
    grid = spark.createDataFrame([(i, float(x)) for i, x in enumerate(np.linspace(-8, 12, 4001))], "g int, at double")
    for name in series.DENSITIES:
        sums = series.kde(df, grid, 0.5, name).groupBy("series_id").agg(F.sum("density").alias("s")).collect()
        assert [r["s"] * 0.005 for r in sums] == pytest.approx([1.0, 1.0], abs=5e-3), name
    with pytest.raises(ValueError):
        series.kde(df, grid, 0.5, "odd")
    every = sorted({x for v in values for x in v})
    widths = np.geomspace(min(np.diff(every)), 3.0 / 3, 50)
    phi = lambda d, h: math.exp(-0.5 * (d / h) ** 2) / (h * math.sqrt(2 * math.pi))
    score = [sum(sum(phi(a - b, h) for j, b in enumerate(v) if j != i) / (len(v) - 1) for v in values for i, a in enumerate(v)) for h in widths]
    assert series.jackknife_bandwidth(df) == pytest.approx(widths[int(np.argmax(score))])


def test_log_gamma(spark):
    xs = [1e-3, 0.5, 1.0, 2.0, 7.5, 1e3, 1e9, 1e15]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(series.log_gamma(F.col("x")).alias("g")).toPandas()["g"]
    assert got.tolist() == pytest.approx([math.lgamma(x) for x in xs], rel=1e-10, abs=1e-10)


def test_signatures_by_blocks(spark):
    rng = np.random.default_rng(6)
    paths_ = {i: rng.normal(size=(n, 2)) for i, n in enumerate([2, 5, 40, 137])}
    flat = [(i, k, *map(float, p)) for i, x in paths_.items() for k, p in enumerate(x)] + [(9, 0, 1.0, 1.0)]
    df = spark.createDataFrame(flat, "path_id int, pos int, x double, y double").repartition(3)
    whole = spark.createDataFrame([(i, x.tolist()) for i, x in paths_.items()], "path_id int, points array<array<double>>")
    for log in (False, True):
        got = {r["path_id"]: r["signature"] for r in paths.signatures_of_rows(df, ["x", "y"], 3, log, block=7, fan=3).collect()}
        want = {r["path_id"]: r["signature"] for r in paths.signatures(whole, 3, log).collect()}
        assert set(got) == set(want)
        assert all(got[i] == pytest.approx(want[i], rel=1e-8, abs=1e-8) for i in want)


def test_options_of_codecs_and_sliding_kernels(spark):
    # by hand: "", a, b, a known, ab known, aba
    assert codecs.lz_phrases("ababab", ("ab",)) == {"": 1, "a": 2, "b": 1, "ab": 1, "aba": 1}
    df = spark.createDataFrame([(0, "ababab"), (2**60 + 1, "aab"), (None, "ab")], "id bigint, s string")
    assert {r["id"] for r in codecs.lz_counts(df).select("id").distinct().collect()} == {0, 2**60 + 1, None}
    zero = E.LZCompressionVectorizer(max_columns=8, base_dictionary=("ab",), hash_function=lambda c: F.length(c)).fit_transform(df)
    assert {r["col_id"] for r in zero.select("col_id").collect()} <= {0, 1, 2, 3}
    rows = long(spark, [[1.0, 2.0, 4.0, 8.0]])
    out = E.SlidingWindowTransformer(3, kernels=[series.differences, series.of_values(lambda v: v**2), series.of_values(np.sum)]).transform(rows).orderBy("start").collect()
    want = [float((np.array(series.differences(3)) @ w) @ (np.array(series.differences(3)) @ w)) for w in (np.array([1, 2, 4.0]), np.array([2, 4, 8.0]))]
    assert [r["values"][0] for r in out] == pytest.approx(want)


def test_procrustes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4))
    q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    y = 3 * x @ q + 7
    pairs = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, x array<double>, y array<double>")
    mx, my, fx, rx, fy, ry = linalg.procrustes(pairs, "first")
    moved = linalg.align(pairs.select("id", "y"), "y", my, fy, ry).orderBy("id").toPandas()
    assert np.stack(moved["y"]) == pytest.approx(x - x.mean(0), abs=1e-8) and fx == pytest.approx(1)


def test_bpe(spark):
    df = spark.createDataFrame(list(enumerate(BPE[0])), "id int, s string")
    merges = codecs.bpe_train(df, max_vocab=10_000)
    got = {r["id"]: " ".join(r["tokens"]) for r in codecs.bpe_encode(df, merges).collect()}
    assert [got[i] for i in range(3)] == BPE[1]
    assert [merges.decode(merges.encode(s)) for s in BPE[0]] == BPE[0]
    lone = codecs.bpe_train(spark.createDataFrame([(0, "abc"), (1, None), (2, "")], "id int, s string"))
    assert lone.pairs == []
    m = E.BytePairEncodingVectorizer().fit_transform(df)
    assert m.agg(F.sum("value")).first()[0] == 6 + 1 + 6


def test_lempel_ziv(spark):
    # by hand: "", a, a again; then "", a, b, a known, ab, a known
    assert codecs.lz_phrases("aaa") == {"": 1, "a": 2}
    assert codecs.lz_phrases("ababab") == {"": 1, "a": 3, "b": 1, "ab": 1}
    df = spark.createDataFrame([(0, "ababab"), (1, None), (2, "")], "id int, s string")
    counts = codecs.lz_counts(df)
    assert {(r["phrase"], r["n"]) for r in counts.collect()} == set(codecs.lz_phrases("ababab").items())
    columns, m = codecs.lz_matrix(counts, None)
    assert columns.count() == m.count()
    with pytest.raises(ValueError):
        codecs.lz_matrix(counts, 1)


def test_mixtures(spark):
    rng = np.random.default_rng(6)
    pts = [(c, (rng.normal(size=2) + (0 if c % 2 else 30)).tolist()) for c in range(5) for _ in range(30)]
    df = spark.createDataFrame(pts, "cloud_id int, point array<double>")
    model = E.DistributionVectorizer(2).fit(df)
    rows = model.transform(df).groupBy("cloud_id").agg(F.sum("value").alias("s"), F.max("value").alias("m")).collect()
    assert all(r["s"] == pytest.approx(30) and r["m"] > 29 for r in rows)
    d = model.ground_distances()
    assert d[0, 0] == pytest.approx(0, abs=1e-6) and d[0, 1] == pytest.approx(30 * math.sqrt(2), rel=0.1)
    with pytest.raises(ValueError):
        mixture.fit_mixture(df, 1)


def test_transport_plans():
    rng = np.random.default_rng(7)
    for n, m in ((4, 4), (7, 3), (3, 9), (1, 5)):
        p, q, c = rng.random(n) + 0.1, rng.random(m) + 0.1, rng.random((n, m))
        plan = transport.transport_plan(p, q, c)
        assert plan.sum(1) == pytest.approx(p / p.sum()) and plan.sum(0) == pytest.approx(q / q.sum())
        # no cycle of two rows and two columns improves it
        for _ in range(200):
            i, k, j, h = rng.integers(n), rng.integers(n), rng.integers(m), rng.integers(m)
            if plan[i, j] > 1e-9 and plan[k, h] > 1e-9:
                assert c[i, j] + c[k, h] <= c[i, h] + c[k, j] + 1e-9
        soft = transport.sinkhorn_plan(p, q, c, 0.02)
        assert (soft * c).sum() >= (plan * c).sum() - 1e-6 and (soft * c).sum() <= (plan * c).sum() + 0.1
    square = transport.transport_plan(np.ones(5), np.ones(5), np.abs(np.arange(5)[:, None] - np.arange(5)[::-1]))
    assert (square > 0).sum() == 5


@pytest.mark.parametrize("method", ["exact", "sinkhorn", "mean"])
def test_wasserstein_vectors(spark, method):
    rng = np.random.default_rng(8)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 4)))], "col_id bigint, vec array<double>")
    m = rng.random((12, 30)) * (rng.random((12, 30)) < 0.3)
    rows = transport.packed_rows(coo(spark, m), vectors)
    model = E.WassersteinVectorizer(method, n_components=3, reference_size=4).fit(rows)
    a, b = (np.stack(model.transform(rows).orderBy("row_id").toPandas()["embedding"]) for _ in range(2))
    assert a == pytest.approx(b) and a.shape == (12, 3)
    with pytest.raises(ValueError):
        transport.metric_of("nothing")


@pytest.mark.parametrize("method", ["exact", "sinkhorn"])
def test_transport_queries_use_whole_embeddings(spark, tmp_path, monkeypatch, method):
    """Vectors against single solutions, on embeddings of 64 numbers that agree in the first 8."""
    from seqloom.plans.queries import QUERIES

    rng = np.random.default_rng(13)
    x = np.hstack([np.ones((96, 8)), rng.normal(size=(96, 56))])
    spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(transport, "compressed", lambda rows, k: (None, rows))
    got = {r["row_id"]: np.array(r["vec"]) for r in QUERIES[f"lot_{method}"](spark, str(tmp_path)).collect()}
    groups = {}
    for i, v in enumerate(x):
        groups.setdefault(i % 2 * 16 + i % 16, []).append(v)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    centre = np.mean([np.mean(g, axis=0) for g in groups.values()], axis=0)
    ref = unit(centre + np.random.default_rng(42).normal(scale=0.01, size=(8, 64)))
    assert set(got) == set(groups)
    for k, g in groups.items():
        assert got[k] == pytest.approx(transport.lot_vector(np.ones(len(g)), unit(np.array(g)), ref, np.full(8, 1 / 8), "cosine", method), abs=1e-6)


def test_signatures(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12, 3))
    whole = paths.signature(x, 3)
    a, b = paths.signature(x[:6], 3), paths.signature(x[5:], 3)
    joined = a[1] + b[1] + np.multiply.outer(a[0], b[0]).ravel()
    assert whole[0] == pytest.approx(x[-1] - x[0]) and whole[1] == pytest.approx(joined)
    log = paths.log_signature(whole)
    assert log[1].reshape(3, 3) == pytest.approx(-log[1].reshape(3, 3).T)
    assert len(paths.lyndon_words(2, 3)) == 5 and len(paths.lyndon_words(3, 2)) == 6
    df = spark.createDataFrame([(0, x.tolist())], "path_id int, points array<array<double>>")
    got = E.SignatureVectorizer(2).transform(df).first()["signature"]
    assert got == pytest.approx(np.concatenate(whole[:2])) and len(E.SignatureVectorizer(3, log=True).transform(df).first()["signature"]) == 14
    rows = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(x)], "path_id int, pos int, a double, b double, c double")
    r = paths.signature_level2(rows, ["a", "b", "c"]).first()
    assert [r[f"s_{i}_{j}"] for i in range(3) for j in range(3)] == pytest.approx(whole[1])


def test_scalar_functions(spark):
    assert (T.size_in_bytes("2G"), T.size_in_bytes("3ki"), T.size_in_bytes("7")) == (2 * 1024**3, 3000, 7)
    with pytest.raises(ValueError):
        T.size_in_bytes("lots")
    df = spark.createDataFrame([(0, [[1, 2], [3]])], "doc_id int, tokens array<array<int>>")
    r = df.select(T.full_flatten("tokens").alias("f"), T.cast_tokens("tokens", nested=True).alias("c")).first()
    assert r["f"] == [1, 2, 3] and r["c"] == [["1", "2"], ["3"]]
    T.check_token_type(df)
    with pytest.raises(ValueError):
        T.check_token_type(spark.createDataFrame([(0, [{"a": 1}])], "doc_id int, tokens array<map<string,int>>"))


def test_pipeline_of_estimators(seqs):
    from pyspark.ml import Pipeline

    model = Pipeline(stages=[E.NgramVectorizer(), E.InformationWeightTransformer()]).fit(seqs(TEXTS))
    assert model.transform(seqs(TEXTS)).count() == 24
    assert E.CooccurrenceVectorizer(rules=V.Prune(min_occurrences=2)).fit(seqs(TEXTS)).reduce_dimension(seqs(TEXTS), 2).count() == 4


def test_streams(spark, tmp_path):
    from seqloom.streaming import incremental as I

    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(I.merge_into(str(tmp_path / "counts"))).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["token"]: r["n"] for r in I.merged_counts(spark, str(tmp_path / "counts")).collect()}
    rows = S.tokens_of_text(spark.read.parquet(str(tmp_path / "in")))
    assert got == {r["token"]: r["n"] for r in V.counts(rows).collect()}
    vocab = V.vocabulary(rows, V.Prune(min_occurrences=2))
    q = I.known_tokens(stream, vocab).writeStream.format("memory").queryName("known").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("known").count() == rows.join(vocab, "token").count()


def test_blocks_of_rows(spark, monkeypatch):
    """Blocks hold whole rows, a long row is one of its own, and string ids stay."""
    monkeypatch.setattr(linalg, "BLOCK_ENTRIES", 7)
    rng = np.random.default_rng(8)
    rows = [(f"r{i % 9}", int(c), float(v)) for i, (c, v) in enumerate(zip(rng.integers(0, 50, 200), rng.integers(1, 9, 200), strict=True))] + [("long", c, 1.0) for c in range(40)]
    df = spark.createDataFrame(rows, "row_id string, col_id int, value double").repartition(5)
    blocks = linalg.csr_blocks(df).collect()
    ids = [i for b in blocks for i in b["ids"]]
    assert sorted(ids) == sorted(set(r[0] for r in rows)) and len(blocks) > 3
    back = linalg.block_entries(linalg.csr_blocks(df, norm=1, power=0.5)).toPandas()
    size = {i: sum(r[2] for r in rows if r[0] == i) for i in ids}
    assert Counter((a, b, round(v, 9)) for a, b, v in back.itertuples(index=False)) == Counter((a, b, round((v / size[a]) ** 0.5, 9)) for a, b, v in rows)
    assert linalg.csr_blocks(df.limit(0)).count() == 0


def test_krylov_of_a_flat_spectrum(spark):
    """Singular values close to each other, which power iteration is slow to part."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 60))
    f = linalg.svd(coo(spark, m), 60, 8)
    assert f.s == pytest.approx(np.linalg.svd(m)[1][:8], rel=1e-6)
    with pytest.warns(UserWarning, match="nothing is compressed"):
        same = linalg.compress_counts(coo(spark, np.abs(m)), 60, 60)[1].toPandas()
    assert np.stack(same.sort_values("row_id")["embedding"]) == pytest.approx(np.abs(m))


def test_long_sequences_are_cut_into_blocks(spark, monkeypatch):
    """Windows over blocks with halos are those over whole sequences."""
    from seqloom.plans import halo

    rng = np.random.default_rng(2)
    rows = [(s, int(p), float(x)) for s, n in ((1, 700), (None, 333), (2, 40), (3, 1)) for p, x in zip(np.cumsum(rng.integers(1, 4, n)), rng.integers(0, 9, n), strict=True)]
    df = spark.createDataFrame(rows, "series_id int, pos int, x double").repartition(6)
    tokens = df.select(F.col("series_id").alias("doc_id"), "pos", F.col("x").cast("int").alias("idx"))
    words = tokens.select("doc_id", "pos", F.concat(F.lit("t"), "idx").alias("token"))
    windows = [WindowSpec("before", 7, harmonic), WindowSpec("after", 3)]
    timed = tokens.withColumn("t", F.col("pos") * 1.0)

    def results():
        long = halo.LONG
        yield series.sliding_windows(df, 9, stride=2, pad=3)
        yield series.sequential_differences(df, 5)
        yield series.count_changepoints(df, 8)
        yield cooc.exploded(cooc.contexts(tokens, windows, long=long))
        for how in ({}, {"normalize": False}, {"mask": 3}):
            yield cooc.context_pairs(tokens, windows, long=long, **how)
        yield cooc.exploded(cooc.timed_contexts(timed, windows, long=long))
        yield grams.ngrams(words, 4, "subgrams", long=long)
        yield grams.pairs_after(tokens, 6, harmonic, long=long)
        yield grams.pairs_after(tokens, 6, harmonic, reverse=True, long=long)
        vocab = V.vocabulary(grams.ngrams(words, 2), key="gram")
        yield cooc.exploded(cooc.ngram_contexts(words, tokens, 2, windows, vocab, long=long))

    pack = lambda df: Counter(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    whole = [pack(r) for r in results()]
    for k, how in enumerate(({}, {"normalize": False}, {"mask": 3}), 4):
        assert whole[k] == pack(cooc.exploded(cooc.contexts(tokens, windows, **how)))
    monkeypatch.setattr(halo, "LONG", 100)
    monkeypatch.setattr(halo, "BLOCK", 16)
    held = halo.blocked(df, "series_id", "pos", 3, 2)
    assert held.cut and held.rows.where("series_id = 1").select("__block").distinct().count() >= 700 // 16
    assert sorted(r[0] for r in held.own(held.rows.where("series_id = 1").withColumn("r", held.rank())).select("r").collect()) == list(range(700))
    assert [pack(r) for r in results()] == whole


def test_ngram_rows_with_masks_and_variable_windows(seqs):
    docs = ["a b c a b d", "d a a b", "c c c c", "b"]
    known = ["a", "b"]

    def brute(texts, radius_of, nullify):
        out: dict = {}
        for text in texts:
            t = [w if w in known else "<m>" for w in text.split()]
            for i in range(len(t) - 1):
                gram = f"{t[i]}_{t[i + 1]}"
                if nullify and gram == "<m>_<m>":
                    continue
                for j, c in enumerate(t):
                    if nullify and c == "<m>":
                        continue
                    if 0 < j - i - 1 <= radius_of(gram):
                        out[gram, f"post_0_{c}"] = out.get((gram, f"post_0_{c}"), 0) + 1
                    if 0 < i - j <= radius_of(gram):
                        out[gram, f"pre_0_{c}"] = out.get((gram, f"pre_0_{c}"), 0) + 1
        return out

    how = {"variant": "ngram", "window_radii": (2,), "token_dictionary": known, "mask": "<m>", "normalize_windows": False}
    for nullify in (False, True):
        got = cells(E.CooccurrenceVectorizer(**how, nullify_mask=nullify).fit(seqs(docs)).labelled(seqs(docs)), "row_label", "col_label")
        assert got == brute(docs, lambda g: 2, nullify)
    some = lambda v, size: v.select("idx", (F.col("n") % 2 + size - 1).cast("int").alias("radius"))
    model = E.CooccurrenceVectorizer(**how, window_functions=(some,)).fit(seqs(docs))
    radii = {"_".join(r["token"]): r["n"] % 2 + 1 for r in model.gram_vocab.collect()}
    assert set(radii.values()) == {1, 2}
    assert cells(model.labelled(seqs(docs)), "row_label", "col_label") == brute(docs, radii.get, False)
    pruned = E.CooccurrenceVectorizer(**how, rules=V.Prune(min_occurrences=3)).fit(seqs(docs))
    assert {tuple(r["token"]) for r in pruned.gram_vocab.collect()} == {("a", "b"), ("<m>", "<m>")}


@pytest.mark.parametrize("mask", [None, 1])
def test_multiset_cells_are_sums_of_multiset_pairs(spark, mask):
    rows = [(d, s, i, (7 * d + 3 * s + i * i) % 4) for d in range(3) for s in range(4) for i in range(5)] + [(9, 0, 0, 2), (9, 2, 0, 2)]
    sets = spark.createDataFrame(rows, "doc_id bigint, set_pos int, item_pos int, idx bigint")
    windows = [WindowSpec("before", 2, geometric(0.5)), WindowSpec("after", 1, lambda d: F.lit(1.0 / (d + 1)), 3.0), WindowSpec("after", 0)]
    want = cells(cooc.cells(cooc.multiset_pairs(sets, windows, mask=mask)), "row_id", "w", "c")
    assert want and cells(cooc.multiset_cells(sets.drop("item_pos"), windows, mask), "row_id", "w", "c") == want


def test_multisets_with_windows_and_masks(spark):
    sets = [[["a", "b"], ["c"], ["a", "x"], []], [["b", "b"], ["y", "a"]]]
    df = spark.createDataFrame(list(enumerate(sets)), "doc_id bigint, sets array<array<string>>")
    known = ["a", "b", "c"]
    for nullify in (False, True):
        want: dict = {}
        for doc in sets:
            for i, own in enumerate(doc):
                for n, x in enumerate(own):
                    for j, other in enumerate(doc):
                        for m, y in enumerate(other):
                            p, q = (v if v in known else "<m>" for v in (x, y))
                            if (i, n) == (j, m) or nullify and "<m>" in (p, q):
                                continue
                            if 0 <= j - i <= 1:
                                want[p, f"post_0_{q}"] = want.get((p, f"post_0_{q}"), 0) + 2 * 0.5 ** (j - i)
                            if 0 <= i - j <= 2:
                                want[p, f"pre_0_{q}"] = want.get((p, f"pre_0_{q}"), 0) + 1
        how = E.MultiSetCooccurrenceVectorizer((1, 2), ("after", "before"), ("geometric", "flat"), ({"power": 0.5}, {}), normalize_windows=False, mix_weights=(2.0, 1.0), token_dictionary=known, mask="<m>", nullify_mask=nullify)
        model = how.fit(df)
        assert cells(model.labelled(df), "row_label", "col_label") == pytest.approx(want)
    assert len(model.reduce_dimension(df, 2).first()["embedding"]) == 2
    with pytest.raises(ValueError):
        E.MultiSetCooccurrenceVectorizer((1, 2), ("after",) * 3).fit(df).transform(df)


def test_trees_with_masks_and_dictionaries(spark):
    nodes, edges = tree(spark, ["abac", "xbc"])
    how = {"window_radius": 2, "orientation": "after", "token_dictionary": ["a", "c"]}
    got = lambda **more: cells(E.LabelledTreeCooccurrenceVectorizer(nodes, **how, **more).fit(edges).transform(edges), "row_label", "col_label")
    assert got(mask="<m>") == {("a", "<m>"): 1, ("a", "a"): 1, ("<m>", "a"): 1, ("<m>", "c"): 3, ("a", "c"): 1, ("<m>", "<m>"): 1}
    assert got(mask="<m>", nullify_mask=True) == {("a", "a"): 1, ("a", "c"): 1}
    assert got() == {("a", "a"): 1, ("a", "c"): 2}


def test_splice_on_cycles_is_removal_one_by_one(spark):
    from collections import defaultdict

    rng = np.random.default_rng(11)
    cases = [([("k", "r1"), ("r1", "r2"), ("r2", "r1"), ("r2", "k")], {"k"})]
    for _ in range(5):
        pairs = [(f"{'rk'[int(a) % 3 == 0]}{a}", f"{'rk'[int(b) % 3 == 0]}{b}") for a, b in rng.integers(0, 9, (16, 2))]
        cases.append((pairs, {x for p in pairs for x in p if x[0] == "k"}))
    edges = [(t, a, b, float(1 + i)) for t, (pairs, _) in enumerate(cases) for i, (a, b) in enumerate(pairs)]
    nodes = sorted({(t, x, x) for t, a, b, _ in edges for x in (a, b)})
    n = spark.createDataFrame(nodes, "tree_id int, node_id string, label string")
    e = spark.createDataFrame(edges, "tree_id int, src string, dst string, weight double")
    order = [(r["tree_id"], r["node_id"]) for r in n.orderBy(F.xxhash64("tree_id", "node_id"), "node_id").collect()]
    ways, weight = defaultdict(float), defaultdict(float)
    for t, a, b, w in edges:
        ways[t, a, b] += 1
        weight[t, a, b] += w
    keep = {(t, x) for t, (_, k) in enumerate(cases) for x in k}
    for t, x in order:
        if (t, x) in keep:
            continue
        own = [k for k in ways if k[0] == t]
        for _, a, mid in own:
            for _, start, b in own:
                if mid == start == x and a != x and b != x:
                    ways[t, a, b] += ways[t, a, x] * ways[t, x, b]
                    weight[t, a, b] += ways[t, a, x] * weight[t, x, b]
        for k in own:
            if x in k[1:]:
                del ways[k], weight[k]
    labels = spark.createDataFrame([(x,) for _, k in cases for x in k], "label string")
    got = {tuple(r)[:3]: r["weight"] for r in graph.splice(n, e, labels)[1].collect()}
    assert got == pytest.approx(dict(weight))


@pytest.mark.parametrize("held", [codecs.HELD, 7])
def test_bpe_merges_are_those_of_the_plain_loop(spark, monkeypatch, held):
    """Several merges a round, a bounded table of pairs and strings written anew change nothing."""
    monkeypatch.setattr(codecs, "HELD", held)
    monkeypatch.setattr(codecs, "PENDING", 5)
    monkeypatch.setattr(codecs, "BLOCK_CODES", 60)
    rng = np.random.default_rng(held)
    texts = ["".join(rng.choice(list("aab cdé"), rng.integers(0, 30))) for _ in range(60)] + ["aaaaaaa", "abab" * 9, "", "a"] * 3
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "id int, s string").repartition(3)
    merges = codecs.bpe_train(df, max_vocab=60)
    want, codes, text = [], [list(map(ord, t)) for t in texts], {c: chr(c) for c in range(0x110000)}
    while 7 + len(want) < 60:
        counts = Counter(p for c in codes for p in zip(c, c[1:], strict=False))
        pair, n = max(counts.items(), key=lambda x: (x[1], len(text[x[0][0]]) + len(text[x[0][1]]), x[0]))
        if n <= 1:
            break
        new = 0x110000 + len(want)
        text[new] = text[pair[0]] + text[pair[1]]
        want.append(pair)
        for k, c in enumerate(codes):
            out, i = [], 0
            while i < len(c):
                hit = tuple(c[i : i + 2]) == pair
                out.append(new if hit else c[i])
                i += 1 + hit
            codes[k] = out
    assert merges.pairs == want
    got = {r["id"]: r["tokens"] for r in codecs.bpe_encode(df, merges, tokens=False).collect()}
    assert all(got[i] == c for i, c in enumerate(codes)) and got[999] == []


def test_bpe_holds_few_codes_and_tokens_at_once(spark, monkeypatch):
    """Blocks of codes are small in an executor, and batches of encoded strings are bounded by their
    characters, whatever a batch of Arrow holds."""
    import pyarrow as pa

    texts = ["vorla wek, été " * 5_000, None, "", "x", *["wek vorla " * 2_000] * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, s string").repartition(1)
    codes = sum(len(t or "") for t in {*texts})
    assert codecs._blocks(df.where("s IS NOT NULL"), 0x110000).agg(F.sum(F.octet_length("codes"))).first()[0] < codes
    merges = codecs.Merges(0x110000, [(ord("w"), ord("e")), (0x110000, ord("k"))])
    made, mapped = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **b: made.append(f) or mapped(self, f, *a, **b))
    got = {r["id"]: r["tokens"] for r in codecs.bpe_encode(df, merges).collect()}
    batches = list(made[0](iter([pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "s": texts})])))
    assert len(batches) > 1 and all(len(pa.Table.from_batches([b])["tokens"].combine_chunks().flatten()) <= codecs.BLOCK_CODES for b in batches)
    rows = [(r["id"], r["tokens"]) for b in batches for r in b.to_pylist()]
    assert [i for i, _ in rows] == list(range(len(texts)))
    assert all(got[i] == t == [merges.text_of(c) for c in merges.encode(texts[i] or "")] for i, t in rows)


def test_log_signatures_in_brackets():
    """Level 3 of three axis steps, by hand: the Baker-Campbell-Hausdorff series of x, y and z."""
    assert paths.bracket((0, 0, 1)) == {(0, 0, 1): 1, (0, 1, 0): -2, (1, 0, 0): 1}
    assert paths.bracket((0, 2, 1)) == {(0, 2, 1): 1, (2, 0, 1): -1, (1, 0, 2): -1, (1, 2, 0): 1}
    log = paths.lyndon_coefficients(paths.log_signature(paths.of_steps(np.eye(3), 3)), 3)
    words = paths.lyndon_words(3, 3)
    got = {w: v for w, v in zip(words, log, strict=True) if abs(v) > 1e-12}
    # log(e^x e^y e^z) = x + y + z + ([x,y] + [x,z] + [y,z]) / 2 + [x,[x,y]] / 12 + ... + [x,[y,z]] / 3 + [[x,z],y] / 6
    half, twelfth = [(0, 1), (0, 2), (1, 2)], [(0, 0, 1), (0, 0, 2), (0, 1, 1), (0, 2, 2), (1, 1, 2), (1, 2, 2)]
    want = {(0,): 1, (1,): 1, (2,): 1} | dict.fromkeys(half, 0.5) | dict.fromkeys(twelfth, 1 / 12) | {(0, 1, 2): 1 / 3, (0, 2, 1): 1 / 6}
    assert got == pytest.approx(want)
    # brackets with these coefficients are the logarithm
    tensor = np.zeros((3, 3, 3))
    for w in words:
        if len(w) == 3:
            for other, c in paths.bracket(w).items():
                tensor[other] += c * got.get(w, 0.0)
    assert tensor.ravel() == pytest.approx(paths.log_signature(paths.of_steps(np.eye(3), 3))[2])


def test_transport_plans_are_optimal():
    """A plan is optimal if potentials exist that no arc beats and that arcs with flow meet."""
    rng = np.random.default_rng(7)
    start = None
    for n, m, even in ((1, 5, False), (6, 1, False), (9, 9, True), (40, 12, False), (256, 64, False), (256, 64, True)):
        p, q = (np.ones(n), np.ones(m)) if even else (rng.random(n), rng.random(m))
        cost = transport.euclidean_cost(rng.normal(size=(n, 5)), rng.normal(size=(m, 5)))
        plan, v = transport.solve_transport(p, q, cost)
        again, start = transport.solve_transport(p, q, cost, v if start is None or len(start) != m else start)
        assert plan.sum(1) == pytest.approx(p / p.sum(), abs=1e-9) and plan.sum(0) == pytest.approx(q / q.sum(), abs=1e-9)
        u = (cost - v).min(axis=1)
        assert (plan * (cost - u[:, None] - v)).sum() == pytest.approx(0, abs=1e-9)
        assert (again * cost).sum() == pytest.approx((plan * cost).sum(), abs=1e-9)


def test_sinkhorn_of_a_batch_is_that_of_rows():
    rng = np.random.default_rng(9)
    q = rng.random(6)
    masses = [rng.random(n) for n in (3, 9, 1, 20)]
    costs = [transport.cosine_cost(rng.normal(size=(len(p), 4)), rng.normal(size=(6, 4))) for p in masses]
    for eps, rounds in ((0.05, 1000), (0.001, 20_000)):
        batch = transport.sinkhorn_plans(masses, q, costs, eps, rounds)
        for p, c, plan in zip(masses, costs, batch, strict=True):
            assert plan == pytest.approx(transport.sinkhorn_plan(p, q, c, eps, rounds), abs=1e-9)
            assert plan.sum(1) == pytest.approx(p / p.sum(), abs=1e-7) and plan.sum(0) == pytest.approx(q / q.sum(), abs=1e-7)
            exact = (transport.transport_plan(p, q, c) * c).sum()
            assert exact - 1e-7 <= (plan * c).sum() <= exact + eps * np.log(6 * len(p) + 1)


def test_generators_are_tables(spark):
    from seqloom.sources import generators

    generate, partitions, schema = generators.day_windows(10, 100, 7, 3, 4)
    rows = generators.table_of(spark, generate, partitions, schema)
    assert rows.rdd.getNumPartitions() == partitions == 8
    assert sorted(map(tuple, rows.collect())) == [(i, s + d) for i, s in enumerate(range(10, 95, 3)) for d in range(7)]
    assert generators.table_of(spark, lambda k: iter(()), 2, "a int").count() == 0


def test_bandwidths_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(series, "CELLS", 16)
    rng = np.random.default_rng(4)
    data = {"a": rng.normal(size=150), "b": rng.exponential(size=60) * 40, "c": np.array([1.0, 1.0, 1.0]), "d": np.array([7.5])}
    rows = [(s, i, float(x)) for s, v in data.items() for i, x in enumerate(v)]
    df = spark.createDataFrame([*rows, ("e", 0, None)], "series_id string, pos int, x double").repartition(4)
    widths = np.geomspace(1e-3, 30, 12)
    got = {(r["series_id"], r["k"]): r["s"] for r in series.gauss_sums(df, widths).collect()}
    for s, v in data.items():
        for k, h in enumerate(widths):
            want = np.exp(-((v[:, None] - v) ** 2) / (2 * h * h)).sum()
            assert got[s, k] == pytest.approx(want, rel=1e-6)


def test_frequent_directions(spark):
    """The sketch of many tasks loses no more than it says, and that is within its bound."""
    rng = np.random.default_rng(6)
    a = rng.normal(size=(900, 30)) * 0.9 ** np.arange(30) * 5
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)] + [(999, None)], "row_id int, vec array<double>").repartition(20)
    sketch = linalg.frequent_directions(df, size=12, fan=3)
    gap = np.linalg.eigvalsh(a.T @ a - sketch.b.T @ sketch.b)
    tail = (np.linalg.svd(a)[1] ** 2)[6:].sum()
    assert sketch.b.shape[0] <= 12 and gap.min() > -1e-6 and gap.max() <= sketch.lost + 1e-6 and sketch.lost <= tail / (12 - 6) + 1e-6
    exact = linalg.frequent_directions(df, size=40)
    assert exact.lost == 0 and exact.factors(5).s == pytest.approx(np.linalg.svd(a)[1][:5])
    whole = df.where("vec is not null")
    f, rows = transport.compressed(whole, 5, sketch=40)
    assert rows.count() == 900 and np.abs(f.v.T @ transport.compressed(whole, 5)[0].v) == pytest.approx(np.eye(5), abs=1e-6)
    assert linalg.frequent_directions(df.limit(0)).b.size == 0


def test_transport_options(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(1, 9, n).astype(float).tolist(), rng.normal(size=(n, 3)).tolist()) for i, n in enumerate((2, 5, 9, 4))]
    df = spark.createDataFrame(rows, "row_id int, weights array<double>, points array<array<double>>")
    for i, w, p in transport.heaviest(df, 4).collect():
        order = sorted(range(len(rows[i][1])), key=lambda k: -rows[i][1][k])[:4] if len(rows[i][1]) > 4 else range(len(rows[i][1]))
        assert w == [rows[i][1][k] for k in order] and p == [rows[i][2][k] for k in order]
    model = E.WassersteinVectorizer("mean", 3, normalization_power=0.5, max_distribution_size=100, n_svd_iter=4).fit(df)
    for r in model.raw(df).collect():
        w = np.array(rows[r["row_id"]][1])
        assert r["vec"] == pytest.approx((w[:, None] * np.array(rows[r["row_id"]][2])).sum(0) / np.sqrt(w.sum()))


def test_models_leave_their_session(seqs, spark, tmp_path):
    models = [
        E.NgramVectorizer(2).fit(seqs(TEXTS)), E.CooccurrenceVectorizer((2, 1), ("after", "before"), mask="<m>", token_dictionary=["foo", "wer"]).fit(seqs(TEXTS)),
        E.SkipgramVectorizer(window_radius=2).fit(seqs(TEXTS)),
    ]
    for i, model in enumerate(models):
        model.save(str(tmp_path / str(i)))
        again = type(model).load(spark.newSession(), str(tmp_path / str(i)))
        assert type(again) is type(model)
        rows = lambda df: Counter(map(tuple, df.collect()))
        assert rows(again.transform(seqs(TEXTS))) == rows(model.transform(seqs(TEXTS)))
    counts = coo(spark, np.arange(1.0, 25.0).reshape(4, 6))
    fitted = E.CountFeatureCompressionTransformer(2).fit(counts)
    fitted.save(str(tmp_path / "c"))
    assert np.stack(E.CountFeatureCompressionModel.load(spark, str(tmp_path / "c")).transform(counts).orderBy("row_id").toPandas()["embedding"]) == pytest.approx(np.stack(fitted.transform(counts).orderBy("row_id").toPandas()["embedding"]))


def test_pairs_over_batches_of_a_stream(spark, tmp_path):
    from seqloom.streaming import incremental as I

    rng = np.random.default_rng(3)
    rows = [(d, p, int(x)) for d in range(3) for p, x in enumerate(rng.integers(0, 5, 40 + d))]
    cuts = [0, 1, 2, 17, 18, 30, 99]
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = spark.createDataFrame([r for r in rows if lo <= r[1] < hi], "doc_id bigint, pos int, idx int").coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id bigint, pos int, idx int").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = I.pairs_over_batches(stream, 4).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    table = spark.createDataFrame(rows, "doc_id bigint, pos int, idx int")
    want = grams.pairs_after(table, 4, lambda d: F.lit(float(d)))
    assert Counter(map(tuple, spark.table("pairs").collect())) == Counter((r["doc_id"], r["head"], r["tail"], int(r["w"])) for r in want.collect())


def test_rows_em_is_row_em_of_each():
    rng = np.random.default_rng(5)
    rows = [rng.integers(1, 30, n).astype(float) for n in (1, 7, 40, 3, 0, 12)]
    backs = [rng.random(len(r)) + 0.01 for r in rows]
    own, mix = weight.rows_em(np.concatenate(rows), np.concatenate(backs), np.array([len(r) for r in rows]))
    at = 0
    for k, (x, b) in enumerate(zip(rows, backs, strict=True)):
        if len(x):
            want, m = weight.row_em(x, b)
            assert own[at : at + len(x)] == pytest.approx(want, abs=1e-9) and mix[k] == pytest.approx(m, abs=1e-9)
        at += len(x)


def test_tokens_of_one_type(spark):
    parse = lambda *docs: spark.createDataFrame([(d,) for d in docs], "s string").select(F.transform(F.from_json("s", "array<variant>"), lambda v: v).alias("tokens"))
    T.check_token_type(parse("[1, 2, 30]", "[4]", "[]"))
    T.check_token_type(parse('["a", "b"]', "[null]"))
    for mixed in (('[1, "foo"]',), ("[1]", '["a"]'), ("[[1]]",)):
        with pytest.raises(ValueError, match="one simple type"):
            T.check_token_type(parse(*mixed))


def test_grams_are_not_counted_in_the_task_of_their_window(seqs):
    """What a hash aggregate holds in a window's task the window can't get, so an exchange lies between."""
    tokens = S.tokens_of_arrays(seqs(TEXTS))
    model = E.NgramVectorizer(ngram_size=2).fit(seqs(TEXTS))
    for df in (grams.ngram_counts(tokens, 2, "subgrams")[1], grams.count_matrix(grams.ngrams(tokens, 2), model.columns)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
        at = next(i for i, line in enumerate(plan) if " Window [" in line)
        above = [line for line in reversed(plan[:at]) if "Exchange" in line or "HashAggregate" in line]
        assert "Exchange" in above[0] and "HashAggregate" in above[1]
