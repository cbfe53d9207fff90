"""Queries over the driver's tables, one for each family of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distances as D
from ..functions.tokens import row_tokens
from ..operators import codecs, cooc, frames, grams, graph, linalg, mixture, paths, series, transport, weight
from ..operators import vocab as V
from ..operators.windows import WindowSpec, expand, geometric, harmonic, kernel_of, timed_geometric, variable_radii
from ..sources import generators
from ..sources import sequences as S

KNOWN = V.Prune(min_document_occurrences=20)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return S.read_table(spark, d, name)


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return S.tokens_of_text(S.spread(_t(spark, d, "documents").select("doc_id", "text"), "doc_id"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Event types of each user in order of time."""
    rows = _t(spark, d, "events").where(F.col("event_type").isNotNull()).withColumn("t", _micros("ts") / 1e6)
    return S.tokens_of_rows(rows, "user_id", ["ts", "event_id"], "event_type", "t")


def _values(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").where(F.col("value").isNotNull())
    return S.tokens_of_rows(rows, "user_id", ["ts", "event_id"], "value").select(F.col("doc_id").alias("series_id"), "pos", F.col("token").alias("x"))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").groupBy(F.col("user_id").alias("series_id"), F.to_date("ts").alias("day")).agg(F.count("*").alias("x"))
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("series_id").orderBy("day")) - 1
    return rows.select("series_id", pos.alias("pos"), "x")


def _micros(c: str):
    """Microseconds since 1970 of a time without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))


def _r(c, places: int = 6):
    return F.round(c, places)


@query
def vocab_freq(spark, d):
    t = _tokens(spark, d)
    total = F.broadcast(t.agg(F.count("*").alias("total")))
    return V.counts(t).crossJoin(total).select("token", "n", _r(F.col("n") / F.col("total"), 9).alias("freq"))


@query
def doc_freq(spark, d):
    docs = F.broadcast(_t(spark, d, "documents").agg(F.count("*").alias("docs")))
    return V.counts(_tokens(spark, d)).crossJoin(docs).select("token", "df", _r(F.col("df") / F.col("docs"), 9).alias("share"))


@query
def vocab_prune(spark, d):
    n = _t(spark, d, "documents").count()
    rules = V.Prune(min_occurrences=5, max_document_frequency=0.4, excluded=("the", "of"))
    return V.vocabulary(_tokens(spark, d), rules, n).select("token", "n", "df", "idx")


@query
def vocab_topk_ties(spark, d):
    return V.vocabulary(_tokens(spark, d), V.Prune(max_unique=100)).select("token", "n", "idx")


@query
def vocab_regex_exclude(spark, d):
    return V.vocabulary(_tokens(spark, d), V.Prune(min_document_occurrences=5, excluded_pattern="[A-Z].*|.*[.,]")).select("token", "n", "idx")


@query
def mask_encode(spark, d):
    t = _tokens(spark, d)
    known = V.encode(t, V.vocabulary(t, KNOWN), mask="<mask>")
    return known.groupBy("idx").agg(F.count("*").alias("n"), F.sum(F.col("pos").cast("long")).alias("pos_sum"))


@query
def encode_closed(spark, d):
    t = _tokens(spark, d)
    known = V.encode(t, V.vocabulary(t, KNOWN))
    return known.groupBy("idx").agg(F.count("*").alias("n"), F.sum(F.col("pos").cast("long")).alias("pos_sum"))


@query
def ngram1(spark, d):
    return grams.ngram_counts(_tokens(spark, d), 1, token_rules=KNOWN)[1]


def _gram_rows(spark, d, behaviour):
    columns, cells = grams.ngram_counts(_tokens(spark, d), 2, behaviour, token_rules=KNOWN, gram_rules=V.Prune(min_document_occurrences=5))
    out = cells.join(columns, cells["col_id"] == columns["idx"])
    return out.select("row_id", F.array_join("label", " ").alias("gram"), "value")


@query
def ngram2_exact(spark, d):
    return _gram_rows(spark, d, "exact")


@query
def ngram_subgrams(spark, d):
    return _gram_rows(spark, d, "subgrams")


@query
def ngram_merge(spark, d):
    docs = _t(spark, d, "documents")
    parts = [grams.ngram_counts(S.tokens_of_text(docs.where(c)), 1, token_rules=KNOWN) for c in (F.col("lang") == "en", F.col("lang") != "en")]
    columns, cells = grams.merge_counts(*parts)
    return cells.groupBy("col_id").agg(F.sum("value").alias("value"), F.count("*").alias("rows")).join(
        columns.select(F.col("idx").alias("col_id"), F.array_join("label", " ").alias("label")), "col_id"
    )


@query
def skipgram_pairs(spark, d):
    t = _tokens(spark, d)
    out = grams.skip_grams(V.encode(t, V.vocabulary(t, KNOWN), close=False), 2, harmonic)
    return out.select("doc_id", "head", "tail", _r("value").alias("value"))


@query
def skipgram_corpus(spark, d):
    t = _tokens(spark, d)
    return grams.corpus_skip_grams(V.encode(t, V.vocabulary(t, KNOWN), close=False), 3, reverse=True)


def _cooc(spark, d, windows, **how):
    out = cooc.cooccurrence(_tokens(spark, d), windows, KNOWN, **how)[1]
    return out.select("row_id", "w", F.col("c").alias("col_id"), _r("value").alias("value"))


@query
def cooc_after_flat(spark, d):
    return _cooc(spark, d, [WindowSpec("after", 5)], normalize=False)


@query
def cooc_directional_harmonic(spark, d):
    return _cooc(spark, d, expand("directional", 3, harmonic), normalize=False)


@query
def cooc_geometric_norm(spark, d):
    return _cooc(spark, d, [WindowSpec("before", 4, geometric(0.9))])


@query
def cooc_offset(spark, d):
    return _cooc(spark, d, [WindowSpec("after", 3, kernel_of("flat", offset=1))], normalize=False)


@query
def cooc_variable_radius(spark, d):
    t = _tokens(spark, d)
    vocab = V.vocabulary(t, KNOWN)
    radii = variable_radii(vocab, 2)
    largest = radii.agg(F.max("radius")).first()[0] or 1
    out = cooc.cooccurrence(t, [WindowSpec("after", largest, own_radii="radius")], vocab=vocab, radii=radii, normalize=False)[1]
    return out.select("row_id", "w", F.col("c").alias("col_id"), "value")


@query
def cooc_mask(spark, d):
    t = _tokens(spark, d)
    vocab = V.vocabulary(t, KNOWN)
    known = V.encode(t, vocab, mask="<mask>")
    out = cooc.cells(cooc.exploded(cooc.contexts(known, [WindowSpec("after", 3)], False, mask=vocab.count())))
    return out.select("row_id", F.col("c").alias("col_id"), "value")


@query
def cooc_colnorm_eps(spark, d):
    return _cooc(spark, d, [WindowSpec("after", 2)], normalize=False, epsilon=0.05)


@query
def cooc_em1(spark, d):
    vocab, out = cooc.cooccurrence(_events(spark, d), [WindowSpec("after", 3, geometric(0.8))], rounds=1)
    return out.select("row_id", F.col("c").alias("col_id"), _r("value").alias("value"))


@query
def cooc_timed(spark, d):
    t = _events(spark, d)
    known = V.encode(t, V.vocabulary(t))
    rows = cooc.timed_contexts(known, [WindowSpec("after", 4)], timed_geometric(0.9), normalize=False)
    return cooc.cells(cooc.exploded(rows)).select("row_id", F.col("c").alias("col_id"), _r("value", 4).alias("value"))


@query
def cooc_ngram_rows(spark, d):
    t = _events(spark, d)
    vocab = V.vocabulary(t)
    known = V.encode(t, vocab)
    named = known.join(vocab.select("idx", "token"), "idx")
    pairs = V.vocabulary(grams.ngrams(named, 2), key="gram")
    rows = cooc.ngram_contexts(named, known, 2, expand("directional", 3), pairs, normalize=False)
    return cooc.cells(cooc.exploded(rows)).select("row_id", "w", F.col("c").alias("col_id"), "value")


@query
def cooc_ngram_mask(spark, d):
    """Pairs of event types in their places, where clicks are masked and neither count nor are counted."""
    t = _events(spark, d)
    vocab = V.vocabulary(t, V.Prune(excluded=("click",)))
    known = V.encode(t, vocab, mask="<mask>")
    named = known.join(V.add_mask(vocab, "<mask>"), "idx")
    pairs = V.vocabulary(grams.ngrams(named, 2), key="gram")
    rows = cooc.ngram_contexts(named, known, 2, expand("directional", 3), pairs, normalize=False, mask=vocab.count(), mask_token="<mask>")
    return cooc.cells(cooc.exploded(rows)).join(pairs, F.col("row_id") == F.col("idx")).select(F.array_join("token", " ").alias("gram"), "w", F.col("c").alias("col_id"), "value")


@query
def cooc_multiset(spark, d):
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    from pyspark.sql import Window

    # lines of an order can share a number, so only what a set holds is used, never the order of its lines
    place = Window.partitionBy("o_custkey").orderBy(F.to_date("o_orderdate").asc_nulls_last())
    sets = rows.select(F.col("o_custkey").alias("doc_id"), (F.dense_rank().over(place) - 1).alias("set_pos"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"))
    sets = sets.withColumn("token", F.concat("a", "b"))
    known = sets.join(V.vocabulary(sets.where(F.col("token").isNotNull())).select("token", "idx"), "token")
    out = cooc.multiset_cells(known, expand("directional", 1, geometric(0.5)))
    return out.select("row_id", "w", F.col("c").alias("col_id"), _r("value").alias("value"))


def _conversations(spark, d):
    turns = _t(spark, d, "conversations").where(F.col("turn").isNotNull())
    nodes = turns.select(F.col("conv_id").alias("tree_id"), F.col("turn").alias("node_id"), F.coalesce("role", F.lit("?")).alias("label"))
    nodes = nodes.dropDuplicates(["tree_id", "node_id", "label"])
    ends = nodes.select("tree_id", F.col("node_id").alias("src"))
    nxt = nodes.select("tree_id", F.col("node_id").alias("dst"))
    edges = ends.withColumn("dst", F.col("src") + 1).join(nxt, ["tree_id", "dst"]).select("tree_id", "src", "dst", F.lit(1.0).alias("weight"))
    return nodes, edges.distinct()


@query
def tree_walks(spark, d):
    nodes, edges = _conversations(spark, d)
    return graph.tree_cooccurrence(nodes, edges, 3, geometric(0.5), "directional").select("row_label", "col_label", _r("value").alias("value"))


@query
def node_splice(spark, d):
    """Conversations without the turns of assistants: users' turns become neighbours."""
    nodes, edges = _conversations(spark, d)
    keep = nodes.select("label").where(F.col("label") != "assistant").distinct()
    return graph.splice(nodes, edges, keep)[1].select("tree_id", "src", "dst", "weight")


@query
def edge_pivot(spark, d):
    edges = S.edge_list(_t(spark, d, "lineitem"), "l_suppkey", "l_shipdate", "l_quantity")
    edges = edges.withColumn("col_label", F.substring("col_label", 1, 7))
    return graph.edge_matrix(edges).select("row_label", "col_label", "row_id", "col_id", _r("value", 2).alias("value"))


@query
def edge_pivot_joint(spark, d):
    rows = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return graph.edge_matrix(S.edge_list(rows, "n_name", "r_name", "s_acctbal"), joint=True).select("row_label", "col_label", "row_id", "col_id", _r("value", 2).alias("value"))


@query
def categorical_lists(spark, d):
    out = frames.categorical_lists(_t(spark, d, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"], "o_orderkey", with_names=True, unique=True)
    return out.select("o_custkey", F.array_join("tokens", "|").alias("tokens"))


@query
def row_token_lists(spark, d):
    orders = _t(spark, d, "orders")
    return orders.select("o_orderkey", F.array_join(row_tokens(["o_orderstatus", "o_orderpriority", "o_custkey"], orders), "|").alias("tokens"))


@query
def hist_uniform(spark, d):
    v = _values(spark, d)
    return series.histogram(v, series.uniform_bins(v, 10)).select("series_id", F.col("bin").cast("int"), "n")


@query
def hist_outlier(spark, d):
    v = _values(spark, d)
    bins = series.outlier_bins(series.uniform_bins(v, 8, low=float("inf"), high=float("-inf")), 8)
    return series.histogram(v, bins).select("series_id", F.col("bin").cast("int"), "n")


@query
def hist_mass(spark, d):
    v = _values(spark, d)
    return series.histogram(v, series.mass_bins(v, 5)).select("series_id", F.col("bin").cast("int"), "n")


@query
def kde_grid(spark, d):
    v = _values(spark, d)
    return series.kde(v, series.grid_of(v, 10), 5.0).select("series_id", F.col("g").cast("int"), _r("density").alias("density"))


@query
def cyclic_month(spark, d):
    return series.cyclic_month(_t(spark, d, "events").where(F.col("ts").isNotNull()), "ts")


@query
def sliding_avg(spark, d):
    rows = series.apply_kernel(series.sliding_windows(_values(spark, d), 5), series.averaging(5))
    return rows.select("series_id", F.col("start").cast("int"), _r(F.col("values")[0]).alias("value"))


@query
def sliding_diff(spark, d):
    n = 6
    rows = series.apply_kernel(series.sliding_windows(_values(spark, d), n, stride=2), series.differences(n, 1, 2, 1))
    return rows.select("series_id", F.col("start").cast("int"), F.posexplode("values").alias("k", "v")).select("series_id", "start", "k", _r("v").alias("value"))


@query
def sliding_pad(spark, d):
    rows = series.sliding_windows(_daily(spark, d), 4, pad=2)
    return rows.select("series_id", F.col("start").cast("int"), F.array_join(F.transform("points", lambda x: x.cast("int").cast("string")), ",").alias("points"))


@query
def seq_difference(spark, d):
    return series.sequential_differences(_values(spark, d), 2).select("series_id", F.col("pos").cast("int"), _r("x").alias("x"))


@query
def changepoint_counts(spark, d):
    return series.count_changepoints(_daily(spark, d), 5).select("series_id", F.col("start").cast("int"), _r("score").alias("score"))


@query
def topk_summary(spark, d):
    columns, cells = grams.ngram_counts(_tokens(spark, d), 1, token_rules=KNOWN)
    top = linalg.summarize(cells, columns.withColumn("label", F.array_join("label", " ")), 3)
    return top.select("row_id", F.col("rank").cast("int"), "label", "value")


def _profiles(spark, d):
    """Counts of event types of each user, beside those of all users, in order of the types."""
    e = _t(spark, d, "events").where(F.col("event_type").isNotNull())
    per = e.groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    all_ = per.groupBy("event_type").agg(F.sum("n").alias("n"))
    whole = F.broadcast(all_.agg(F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("all")))  # one row, a value a type
    mine = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    x = F.transform("all", lambda a: F.coalesce(F.get(F.filter(F.map_entries("m"), lambda b: b["key"] == a["event_type"]), F.lit(0))["value"], F.lit(0.0)))
    return mine.crossJoin(whole).select("user_id", x.alias("x"), F.transform("all", lambda a: a["n"]).alias("y"))


@query
def dist_profiles(spark, d):
    x, y = F.col("x"), F.col("y")
    return _profiles(spark, d).select(
        "user_id", _r(D.hellinger(x, y)).alias("hellinger"), _r(D.total_variation(x, y)).alias("total_variation"),
        _r(D.jensen_shannon(x, y)).alias("jensen_shannon"), _r(D.symmetric_kl(x, y)).alias("symmetric_kl"),
        _r(D.kantorovich(x, y)).alias("kantorovich"), _r(D.kantorovich(x, y, 2)).alias("kantorovich2"),
        _r(D.circular_kantorovich(x, y)).alias("circular"),
    )


@query
def dist_sparse(spark, d):
    """Each user's event types in the first and in the second half of days."""
    e = _t(spark, d, "events").where(F.col("event_type").isNotNull())
    part = lambda c: e.where(c).groupBy(F.col("user_id").alias("pair"), F.col("event_type").alias("col_id")).agg(F.count("*").cast("double").alias("value"))
    out = D.sparse_distances(D.aligned(part(F.hour("ts") < 12), part(F.hour("ts") >= 12)))
    return out.select(F.col("pair").alias("user_id"), *[_r(F.coalesce(c, F.lit(-1.0))).alias(c) for c in ("hellinger", "total_variation", "jensen_shannon", "symmetric_kl")])


def _matrix(spark, d):
    return grams.ngram_counts(_tokens(spark, d), 1, token_rules=KNOWN)[1]


@query
def info_weight_exact(spark, d):
    return weight.information_weights(_matrix(spark, d), 0.1).select("col_id", _r("weight").alias("weight"))


@query
def info_weight_approx(spark, d):
    return weight.information_weights(_matrix(spark, d), 0.1, approximate=True).select("col_id", _r("weight").alias("weight"))


@query
def info_weight_supervised(spark, d):
    labels = _t(spark, d, "labels").where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("row_id")).agg(F.max("quality").alias("label"))
    return weight.supervised_weights(_matrix(spark, d), labels, 0.1).select("col_id", _r("weight").alias("weight"))


@query
def info_weighted(spark, d):
    m = _matrix(spark, d)
    out = weight.weigh(m, weight.fit_information_weights(m, strength=0.1))
    return out.groupBy("row_id").agg(_r(F.sum("value"), 4).alias("mass"))


@query
def row_denoise(spark, d):
    return weight.denoise_rows(_matrix(spark, d)).select("row_id", "col_id", _r("value").alias("value"))


@query
def row_denoise_mass(spark, d):
    """What of each document's counts is its own."""
    return weight.denoise_rows(_matrix(spark, d)).groupBy("row_id").agg(_r(F.sum("value"), 4).alias("mass"))


@query
def lz_events(spark, d):
    """Phrases of each user's events, a letter an event."""
    e = _t(spark, d, "events").where(F.col("event_type").isNotNull())
    parts = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.substring("event_type", 1, 1).alias("c"))))
    strings = e.groupBy("user_id").agg(F.array_join(F.transform(parts, lambda x: x["c"]), "").alias("s"))
    out = codecs.lz_counts(strings, "user_id", "s").groupBy("id")
    return out.agg(F.count("*").alias("phrases"), F.sum("n").alias("n"), F.max(F.char_length("phrase")).alias("longest"))


@query
def bag_mean_vector(spark, d):
    e = _t(spark, d, "embeddings").where(F.col("embedding").isNotNull() & F.col("label").isNotNull())
    vectors = e.select(F.col("vec_id").alias("col_id"), F.col("embedding").cast("array<double>").alias("vec"))
    coo = e.select(F.col("label").alias("row_id"), F.col("vec_id").alias("col_id"), F.lit(1.0).alias("value"))
    return transport.mean_vectors(coo, vectors).select("row_id", F.posexplode("vec").alias("k", "x")).select("row_id", "k", _r("x").alias("x"))


@query
def signature_level2(spark, d):
    e = _t(spark, d, "events").where(F.col("value").isNotNull())
    rows = e.select(F.col("user_id").alias("path_id"), F.struct("ts", "event_id").alias("pos"), (_micros("ts") / 8.64e10).alias("t"), F.col("value").alias("v"))
    out = paths.signature_level2(rows, ["t", "v"])
    return out.select("path_id", *[_r(c, 3).alias(c) for c in out.columns if c != "path_id"])


@query
def signatures_log3(spark, d):
    e = _t(spark, d, "events").where(F.col("value").isNotNull())
    rows = e.select(F.col("user_id").alias("path_id"), F.struct(_micros("ts").alias("t"), "event_id").alias("pos"), (_micros("ts") / 8.64e10 - 19000).alias("t"), F.col("value").alias("v"))
    out = paths.signatures_of_rows(rows, ["t", "v"], 3, log=True)
    names = ["l_0", "l_1", "l_01", "l_001", "l_011"]
    return out.select("path_id", *[_r(F.col("signature")[i], 3).alias(n) for i, n in enumerate(names)])


@query
def svd_compress(spark, d):
    columns, m = grams.ngram_counts(_tokens(spark, d), 1, token_rules=V.Prune(min_document_occurrences=50))
    return linalg.compress_counts(m, columns.count(), 16)[1]


@query
def svd_spectrum(spark, d):
    """Power sums of all singular values of the embeddings: the traces of powers of their Gram matrix."""
    e = _t(spark, d, "embeddings").where(F.col("embedding").isNotNull())
    coo = S.matrix_of_arrays(e.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("values")))
    s = linalg.svd(coo, 64, 64).s
    rows = e.count()
    return spark.createDataFrame([(p, round(float(((s * s / rows) ** p).sum()), 6)) for p in (1, 2, 3)], "power int, value double")


@query
def generated_windows(spark, d):
    """Events in sliding windows of a week; the windows come from a generator in each task."""
    e = _t(spark, d, "events").where(F.col("ts").isNotNull()).select(F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias("day"))
    ends = e.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    windows = generators.table_of(spark, *generators.day_windows(ends["a"], ends["b"], 7)) if ends["a"] is not None else spark.createDataFrame([], "window bigint, day bigint")
    daily = e.groupBy("day").agg(F.count("*").alias("n"))
    return windows.join(daily, "day", "left").groupBy("window").agg(F.min("day").alias("first_day"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query
def cooc_reduced(spark, d):
    t = _tokens(spark, d)
    vocab, out = cooc.cooccurrence(t, [WindowSpec("after", 5)], V.Prune(min_document_occurrences=50))
    return linalg.reduce_cooccurrence(out.select("row_id", F.col("c").alias("col_id"), "value"), vocab.count(), 16)


@query
def bpe_tokens(spark, d):
    rows = _t(spark, d, "documents")
    merges = codecs.bpe_train(rows, "text", max_vocab=300)
    return codecs.bpe_encode(rows, merges, "doc_id", "text").select("id", F.size("tokens").alias("n"), F.array_join("tokens", "|").alias("tokens"))


@query
def lz_counts(spark, d):
    return codecs.lz_counts(_t(spark, d, "documents"), "doc_id", "text").groupBy("id").agg(F.count("*").alias("phrases"), F.sum("n").alias("n"))


@query
def gmm_clouds(spark, d):
    e = _t(spark, d, "events").where(F.col("value").isNotNull())
    pts = e.select(F.col("user_id").alias("cloud_id"), F.array(F.hour("ts") + F.minute("ts") / 60.0, F.col("value")).alias("point"))
    means, covs = mixture.fit_mixture(pts, 4)
    return mixture.cloud_vectors(pts, means, covs).select("cloud_id", "component", _r("value").alias("value"))


def _distributions(spark, d):
    """Groups of embeddings, by label and remainder of the id, as distributions over their vectors."""
    e = _t(spark, d, "embeddings").where(F.col("embedding").isNotNull() & F.col("label").isNotNull())
    vectors = e.select(F.col("vec_id").alias("col_id"), F.col("embedding").cast("array<double>").alias("vec"))
    coo = e.select((F.col("label") * 16 + F.pmod("vec_id", F.lit(16))).alias("row_id"), F.col("vec_id").alias("col_id"), F.lit(1.0).alias("value"))
    return transport.packed_rows(coo, vectors)


@query
def lot_exact(spark, d):
    rows = _distributions(spark, d)
    return transport.compressed(transport.ot_vectors(rows, transport.reference_of(rows, 8), "exact"), 16)[1]


@query
def lot_sinkhorn(spark, d):
    rows = _distributions(spark, d)
    return transport.compressed(transport.ot_vectors(rows, transport.reference_of(rows, 8), "sinkhorn"), 16)[1]


@query
def procrustes(spark, d):
    e = _t(spark, d, "embeddings").where(F.col("embedding").isNotNull())
    both = e.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.reverse("embedding").cast("array<double>").alias("y"))
    _, my, _, _, fy, ry = linalg.procrustes(both)
    out = linalg.align(both.select("vec_id", "y"), "y", my, fy, ry)
    return out.select("vec_id", F.posexplode("y").alias("k", "x")).select("vec_id", "k", (_r("x") + 0.0).alias("x"))
