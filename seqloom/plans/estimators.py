"""Estimators and models with the interface of pyspark.ml.

An estimator is given a DataFrame and fits a model, a model transforms DataFrames, and both compose
in a pyspark.ml Pipeline. Inputs are arrays a row (`doc_id`, `tokens`) or what an operator names;
outputs are matrices in coordinates or dense rows. Fitted state is tables and small arrays."""

from __future__ import annotations

import io
import pickle
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark import cloudpickle
from pyspark.ml import Estimator, Model, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codecs, cooc, frames, grams, graph, linalg, mixture, paths, series, transport, weight
from ..operators import vocab as V
from ..operators.windows import WindowSpec, expand, kernel_of, timed_kernel_of, window_function
from ..sources import sequences as S
from .tables import numbered


class _Params:
    """What dataclasses give in place of ml's parameter maps."""

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        cls.__hash__ = object.__hash__

    def copy(self, extra=None):
        return type(self)(**{f.name: getattr(self, f.name) for f in fields(self) if f.init})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def save(self, path: str) -> None:
        """Write an estimator or a model under a path, which must not exist: its tables as Parquet, the
        rest as one row of bytes that only trusted paths should be loaded from."""
        tables: list[DataFrame] = []

        class Pickler(cloudpickle.Pickler):
            def persistent_id(self, x):
                if not isinstance(x, DataFrame):
                    return None
                tables.append(x)
                return len(tables) - 1

        out = io.BytesIO()
        Pickler(out).dump(self)
        for i, df in enumerate(tables):
            df.write.parquet(f"{path}/table-{i}")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(out.getvalue(),)], "object binary").coalesce(1).write.parquet(f"{path}/object")

    @staticmethod
    def load(spark: SparkSession, path: str):
        """What save() wrote, in any session."""

        class Unpickler(pickle.Unpickler):
            def persistent_load(self, i):
                return spark.read.parquet(f"{path}/table-{i}")

        return Unpickler(io.BytesIO(spark.read.parquet(f"{path}/object").first()["object"])).load()

    def __post_init__(self):
        super().__init__()


class _Fit(_Params, Estimator):
    metric_ = "euclidean"


class _Fitted(_Params, Model):
    metric_ = "euclidean"


class _Plain(_Params, Transformer):
    def fit(self, df: DataFrame):
        return self


def _rows(df: DataFrame) -> DataFrame:
    """Token rows of array rows, or the rows themselves if they are in long form."""
    return df if "token" in df.columns else S.tokens_of_arrays(df)


def _documents(df: DataFrame) -> int:
    return df.count() if "token" not in df.columns else df.select("doc_id").distinct().count()


def _vocabulary(rows: DataFrame, given: list | None, rules: V.Prune, documents: int | None) -> DataFrame:
    """(token, idx, n, df): a given list of tokens in its order, with their counts, or what the
    rules leave."""
    if given is None:
        return V.require_tokens(V.vocabulary(rows, rules, documents))
    fixed = V.fixed_vocabulary(rows.sparkSession, list(given)).join(V.counts(rows), "token", "left")
    return fixed.select("token", F.col("idx").cast("long").alias("idx"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("df", F.lit(0)).alias("df"))


@dataclass(eq=False)
class NgramVectorizer(_Fit):
    """Documents by n-grams, counted. Rules prune tokens and then grams, unless dictionaries are
    given. A mask stands for other tokens; with nullify_mask grams that hold it do not count."""

    ngram_size: int = 1
    ngram_behaviour: str = "exact"
    rules: V.Prune = V.NO_PRUNING
    mask: str | None = None
    token_dictionary: list | None = None
    ngram_dictionary: list | None = None
    nullify_mask: bool = False
    metric_ = "hellinger"

    def _fit(self, df: DataFrame) -> NgramModel:
        needs = self.rules.min_document_frequency is not None or self.rules.max_document_frequency is not None
        documents, rows = _documents(df) if needs else None, _rows(df)
        model = NgramModel(self, _vocabulary(rows, self.token_dictionary, self.rules, documents))
        if self.ngram_dictionary is None:
            model.columns = V.vocabulary(model.grams(rows), self.rules, documents, key="gram").withColumnRenamed("token", "label")
        else:
            kind = dict(rows.dtypes)["token"]
            grams_ = [([g] if isinstance(g, str) or not hasattr(g, "__iter__") else list(g), i) for i, g in enumerate(self.ngram_dictionary)]
            model.columns = rows.sparkSession.createDataFrame(grams_, f"label array<{kind}>, idx bigint")
        return model


@dataclass(eq=False)
class NgramModel(_Fitted):
    how: NgramVectorizer
    vocab: DataFrame
    columns: DataFrame | None = None

    def grams(self, rows: DataFrame) -> DataFrame:
        out = grams.ngrams(grams.known_tokens(rows, self.vocab, self.how.mask), self.how.ngram_size, self.how.ngram_behaviour)
        return out.where(~F.array_contains("gram", self.how.mask)) if self.how.nullify_mask and self.how.mask is not None else out

    def _transform(self, df: DataFrame) -> DataFrame:
        return grams.count_matrix(self.grams(_rows(df)), self.columns)

    def __add__(self, other: NgramModel) -> NgramModel:
        """One model of two corpora: vocabularies united, counts added."""
        if self.how.ngram_size > 1 or other.how.ngram_size > 1 or self.how != other.how and self.how.rules != other.how.rules:
            raise NotImplementedError("only 1-gram models of equal rules merge")
        columns = numbered(
            self.columns.select("label", "n", "df").unionByName(other.columns.select("label", "n", "df")).groupBy("label").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "label"
        )
        return NgramModel(self.how, V.merged_vocabulary(self.vocab, other.vocab), columns)


def _encoded(rows: DataFrame, vocab: DataFrame, mask: str | None, radii: DataFrame | None) -> DataFrame:
    """Token rows by index in their order; unknown tokens go, or have the mask's index."""
    out = V.encode(rows, vocab, mask, close=False)
    return out if radii is None else out.join(radii, "idx", "left")


@dataclass(eq=False)
class SkipgramVectorizer(_Fit):
    """Documents by ordered token pairs within a window, of one radius or of each token's own
    (window_function "variable" or a callable). Masked tokens keep their places, and their
    pairs do not count."""

    window_radius: int = 5
    kernel: str = "flat"
    kernel_args: dict = field(default_factory=dict)
    rules: V.Prune = V.NO_PRUNING
    window_function: Any = "fixed"
    token_dictionary: list | None = None
    mask: str | None = None

    def _fit(self, df: DataFrame) -> SkipgramModel:
        rows = _rows(df)
        model = SkipgramModel(self, _vocabulary(rows, self.token_dictionary, self.rules, _documents(df)), self.window_radius)
        f = window_function(self.window_function)
        if f is not None:
            model.radii = f(model.vocab, self.window_radius).select("idx", "radius")
            model.radius = model.radii.agg(F.max("radius")).first()[0] or 1
        model.columns = numbered(model.pairs(rows).select("head", "tail").distinct(), "head", "tail")
        return model


@dataclass(eq=False)
class SkipgramModel(_Fitted):
    how: SkipgramVectorizer
    vocab: DataFrame
    radius: int
    radii: DataFrame | None = None
    columns: DataFrame | None = None

    @property
    def kernel(self):
        return kernel_of(self.how.kernel, **self.how.kernel_args)

    def pairs(self, rows: DataFrame) -> DataFrame:
        mask = self.vocab.where(F.col("token") != self.how.mask).count() if self.how.mask is not None else None
        return grams.skip_grams(_encoded(rows, self.vocab, self.how.mask, self.radii), self.radius, self.kernel, own_radii=None if self.radii is None else "radius", mask=mask)

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.pairs(_rows(df)).join(self.columns, ["head", "tail"]).select(F.col("doc_id").alias("row_id"), F.col("idx").alias("col_id"), "value")


@dataclass(eq=False)
class CooccurrenceVectorizer(_Fit):
    """Tokens by the tokens around them. variant: token, timed (rows with t) or ngram.

    Windows are lists of equal lengths, or one value for all: radii, orientations, kernels with
    their arguments, weights, and functions, "fixed", "variable" or a callable from the
    vocabulary and a size to each token's radius. A mask stands for tokens outside the
    vocabulary; with nullify_mask it neither counts nor is counted."""

    window_radii: tuple[int, ...] = (5,)
    orientations: tuple[str, ...] = ("directional",)
    kernel: Any = "flat"
    kernel_args: Any = field(default_factory=dict)
    mix_weights: tuple[float, ...] | None = None
    normalize_windows: bool = True
    n_iter: int = 0
    epsilon: float = 0.0
    rules: V.Prune = V.NO_PRUNING
    variant: str = "token"
    ngram_size: int = 2
    window_functions: Any = ("fixed",)
    token_dictionary: list | None = None
    mask: str | None = None
    nullify_mask: bool = False

    def _each(self, value: Any, name: str) -> list:
        out = list(value) if isinstance(value, tuple | list) else [value]
        if len(out) not in (1, len(self.window_radii)):
            raise ValueError(f"{name}: one value, or as many as radii")
        return out * len(self.window_radii) if len(out) == 1 else out

    def functions(self) -> list:
        return [window_function(f) for f in self._each(self.window_functions, "window_functions")]

    def kernels(self) -> list:
        make = timed_kernel_of if self.variant == "timed" else kernel_of
        return [make(k, **a) for k, a in zip(self._each(self.kernel, "kernel"), self._each(self.kernel_args, "kernel_args"), strict=True)]

    def windows(self, largest: dict[int, int] | None = None) -> list[WindowSpec]:
        """largest: the largest radius of each window with a function."""
        if self.mix_weights is not None and len(self.mix_weights) != len(self.window_radii):
            raise ValueError("radii, orientations and weights are of one length")
        mixes = self.mix_weights or (1.0,) * len(self.window_radii)
        kernels = [kernel_of("flat")] * len(self.window_radii) if self.variant == "timed" else self.kernels()
        own = [f"radius{i}" if f is not None and largest else None for i, f in enumerate(self.functions())]
        parts = zip(self.window_radii, self._each(self.orientations, "orientations"), kernels, mixes, own, strict=True)
        return [w for i, (r, o, k, m, c) in enumerate(parts) for w in expand(o, (largest or {}).get(i, r), k, m, c)]

    def _fit(self, df: DataFrame) -> CooccurrenceModel:
        rows = _rows(df)
        model = CooccurrenceModel(self, _vocabulary(rows, self.token_dictionary, self.rules, _documents(df)))
        if self.variant == "ngram":
            # grams are pruned by the rules of tokens; a mask keeps its place in them
            known = V.encode(rows, model.vocab, self.mask, close=False).join(model.names().select("idx", "token"), "idx")
            rules = replace(self.rules, excluded=(), excluded_pattern=None)
            model.gram_vocab = V.require_tokens(V.vocabulary(grams.ngrams(known, self.ngram_size), rules, _documents(df), key="gram"))
        for i, f in enumerate(self.functions()):
            if f is not None:
                own = f(model.vocab if model.gram_vocab is None else model.gram_vocab, self.window_radii[i]).select("idx", F.col("radius").alias(f"radius{i}"))
                model.largest[i] = own.agg(F.max(f"radius{i}")).first()[0] or 1
                model.radii = own if model.radii is None else model.radii.join(own, "idx")
        if self.variant == "timed":
            model.delta = cooc.mean_gap(V.encode(rows, model.vocab))
        return model


@dataclass(eq=False)
class CooccurrenceModel(_Fitted):
    how: CooccurrenceVectorizer
    vocab: DataFrame
    delta: DataFrame | None = None
    gram_vocab: DataFrame | None = None
    radii: DataFrame | None = None
    largest: dict[int, int] = field(default_factory=dict)

    def windows(self) -> list[WindowSpec]:
        return self.how.windows(self.largest)

    def _contexts(self, rows: DataFrame, normalize: bool) -> DataFrame:
        how, windows = self.how, self.windows()
        known = V.encode(rows, self.vocab, how.mask, close=False)
        mask = self.vocab.where(F.col("token") != how.mask).count() if how.mask is not None and how.nullify_mask else None
        if how.variant == "timed":
            # a window in one orientation or in two; each has its own kernel
            kernels = [k for k, o in zip(how.kernels(), how._each(how.orientations, "orientations"), strict=True) for _ in expand(o)]
            known = known if self.radii is None else known.join(self.radii, "idx", "left")
            return cooc.timed_contexts(known, windows, kernels, self.delta, normalize, mask)
        if how.variant == "ngram":
            named = known.join(self.names().select("idx", "token"), "idx")
            return cooc.ngram_contexts(named, known, how.ngram_size, windows, self.gram_vocab, normalize, self.radii, mask, how.mask)
        return cooc.contexts(known, windows, normalize, self.radii, mask)

    def _transform(self, df: DataFrame) -> DataFrame:
        """(row_id, w, c, value)."""
        rows = _rows(df)
        out = cooc.cells(cooc.exploded(self._contexts(rows, self.how.normalize_windows)))
        if self.how.n_iter or self.how.epsilon > 0:
            out = cooc.em(cooc.exploded(self._contexts(rows, False)), out, self.how.n_iter, self.how.epsilon)
        return out

    def names(self) -> DataFrame:
        """(token, idx), the mask included."""
        return self.vocab if self.how.mask is None else V.add_mask(self.vocab, self.how.mask)

    def labelled(self, df: DataFrame) -> DataFrame:
        names = self.names()
        rows = names if self.gram_vocab is None else self.gram_vocab.select("idx", F.array_join("token", "_").alias("token"))
        return cooc.labelled(self.transform(df), self.windows(), rows, names)

    def reduce_dimension(self, df: DataFrame, dimension: int = 150, power: float = 0.25, n_iter: int = 7, seed: int = 0) -> DataFrame:
        n = self.vocab.count() + (self.how.mask is not None)
        coo = self.transform(df).select("row_id", (F.col("c") + F.col("w") * n).alias("col_id"), "value")
        return linalg.reduce_cooccurrence(coo, n * len(self.windows()), dimension, power, self.how.n_iter > 0, n_iter, seed)


@dataclass(eq=False)
class MultiSetCooccurrenceVectorizer(_Fit):
    """Tokens by what shares their set or is in the sets around it; rows (doc_id, sets).

    Radii, orientations, kernels and their arguments are one value or a list with one a window; a mask
    stands for tokens outside the vocabulary, and with nullify_mask neither counts nor is counted."""

    window_radius: Any = 5
    orientation: Any = "directional"
    kernel: Any = "flat"
    kernel_args: Any = field(default_factory=dict)
    normalize_windows: bool = True
    n_iter: int = 0
    epsilon: float = 0.0
    rules: V.Prune = V.NO_PRUNING
    mix_weights: tuple[float, ...] | None = None
    token_dictionary: list | None = None
    mask: str | None = None
    nullify_mask: bool = False

    def windows(self) -> list[WindowSpec]:
        many = [len(v) for v in (self.window_radius, self.orientation, self.kernel, self.kernel_args, self.mix_weights) if isinstance(v, tuple | list)]
        n = max(many, default=1)
        if set(many) - {n}:
            raise ValueError("radii, orientations, kernels and weights are of one length")
        each = lambda v: list(v) if isinstance(v, tuple | list) else [v] * n
        parts = zip(*map(each, (self.window_radius, self.orientation, self.kernel, self.kernel_args, 1.0 if self.mix_weights is None else self.mix_weights)), strict=True)
        return [w for r, o, k, args, mix in parts for w in expand(o, r, kernel_of(k, **args), mix)]

    def _fit(self, df: DataFrame) -> MultiSetCooccurrenceModel:
        return MultiSetCooccurrenceModel(self, _vocabulary(S.multisets_of_arrays(df), self.token_dictionary, self.rules, df.count()))


@dataclass(eq=False)
class MultiSetCooccurrenceModel(_Fitted):
    how: MultiSetCooccurrenceVectorizer
    vocab: DataFrame

    def _transform(self, df: DataFrame) -> DataFrame:
        """(row_id, w, c, value)."""
        how, windows = self.how, self.how.windows()
        known = V.encode(S.multisets_of_arrays(df), self.vocab, how.mask, close=False)
        mask = self.vocab.where(F.col("token") != how.mask).count() if how.mask is not None and how.nullify_mask else None
        pairs = lambda n: cooc.multiset_pairs(known, windows, n, mask).withColumn("pos", F.struct("set_pos", "item_pos"))
        out = cooc.cells(pairs(how.normalize_windows))
        return cooc.em(pairs(False), out, how.n_iter, how.epsilon) if how.n_iter or how.epsilon > 0 else out

    def labelled(self, df: DataFrame) -> DataFrame:
        names = self.vocab if self.how.mask is None else V.add_mask(self.vocab, self.how.mask)
        return cooc.labelled(self.transform(df), self.how.windows(), names, names)

    def reduce_dimension(self, df: DataFrame, dimension: int = 150, power: float = 0.25, n_iter: int = 7, seed: int = 0) -> DataFrame:
        n = self.vocab.count() + (self.how.mask is not None)
        coo = self.transform(df).select("row_id", (F.col("c") + F.col("w") * n).alias("col_id"), "value")
        return linalg.reduce_cooccurrence(coo, n * len(self.how.windows()), dimension, power, self.how.n_iter > 0, n_iter, seed)


@dataclass(eq=False)
class LabelledTreeCooccurrenceVectorizer(_Fit):
    """Labels that walks in trees connect. Trees are edges (tree_id, src, dst, weight); their nodes
    (tree_id, node_id, label) are a parameter, as are the rules on labels or a dictionary of them.
    Nodes of other labels are spliced out, or with a mask stay in their places under its
    name; with nullify_mask the mask's own cells go."""

    nodes: DataFrame
    window_radius: int = 5
    orientation: str = "directional"
    kernel: str = "flat"
    kernel_args: dict = field(default_factory=dict)
    rules: V.Prune = V.NO_PRUNING
    mask: str | None = None
    nullify_mask: bool = False
    token_dictionary: list | None = None

    def _fit(self, df: DataFrame) -> LabelledTreeCooccurrenceModel:
        tokens = self.nodes.select(F.col("tree_id").alias("doc_id"), F.col("label").alias("token"))
        vocab = _vocabulary(tokens, self.token_dictionary, self.rules, tokens.select("doc_id").distinct().count())
        return LabelledTreeCooccurrenceModel(self, vocab)


@dataclass(eq=False)
class LabelledTreeCooccurrenceModel(_Fitted):
    how: LabelledTreeCooccurrenceVectorizer
    vocab: DataFrame
    nodes: DataFrame | None = None

    def _transform(self, df: DataFrame) -> DataFrame:
        """(row_label, col_label, value); set nodes for trees other than the fitted ones."""
        how, nodes = self.how, self.nodes if self.nodes is not None else self.how.nodes
        keep = self.vocab.select(F.col("token").alias("label"))
        return graph.tree_cooccurrence(nodes, df, how.window_radius, kernel_of(how.kernel, **how.kernel_args), how.orientation, keep, how.mask, how.nullify_mask)


@dataclass(eq=False)
class EdgeListVectorizer(_Fit):
    rows: DataFrame | None = None
    columns: DataFrame | None = None
    joint_space: bool = False

    def _fit(self, df: DataFrame) -> EdgeListModel:
        m = graph.edge_matrix(df, self.rows, self.columns, self.joint_space)
        names = lambda given, label, idx: given if given is not None else m.select(F.col(label).alias("label"), F.col(idx).alias("idx")).distinct()
        return EdgeListModel(names(self.rows, "row_label", "row_id"), names(self.columns, "col_label", "col_id"))


@dataclass(eq=False)
class EdgeListModel(_Fitted):
    rows: DataFrame
    columns: DataFrame

    def _transform(self, df: DataFrame) -> DataFrame:
        return graph.edge_matrix(df, self.rows, self.columns).select("row_id", "col_id", "value")


@dataclass(eq=False)
class HistogramVectorizer(_Fit):
    n_components: int = 20
    strategy: str = "uniform"
    low: float | None = None
    high: float | None = None
    append_outlier_bins: bool = False

    def _fit(self, df: DataFrame) -> HistogramModel:
        n = self.n_components
        if self.strategy == "uniform":
            if self.append_outlier_bins:
                inner = series.uniform_bins(df, n, float("inf"), float("-inf"))
                return HistogramModel(series.outlier_bins(inner, n))
            return HistogramModel(series.uniform_bins(df, n, self.low, self.high))
        if self.strategy in ("mass", "quantile"):
            return HistogramModel(series.mass_bins(df, n) if self.strategy == "mass" else series.quantile_bins(df, n))
        raise ValueError("the strategy is uniform, mass or quantile")


@dataclass(eq=False)
class HistogramModel(_Fitted):
    bins: DataFrame

    def _transform(self, df: DataFrame) -> DataFrame:
        return series.histogram(df, self.bins)


@dataclass(eq=False)
class KDEVectorizer(_Fit):
    bandwidth: float | None = None
    n_components: int = 50
    evaluation_grid_strategy: str = "uniform"
    kernel: str = "gaussian"

    def _fit(self, df: DataFrame) -> KDEModel:
        h = self.bandwidth if self.bandwidth is not None else series.jackknife_bandwidth(df)
        return KDEModel(series.grid_of(df, self.n_components, self.evaluation_grid_strategy), h, self.kernel)


@dataclass(eq=False)
class KDEModel(_Fitted):
    grid: DataFrame
    bandwidth: float
    kernel: str = "gaussian"

    def _transform(self, df: DataFrame) -> DataFrame:
        return series.kde(df, self.grid, self.bandwidth, self.kernel)


@dataclass(eq=False)
class DistributionVectorizer(_Fit):
    n_components: int = 20
    seed: int = 1
    metric_ = "wasserstein"

    def _fit(self, df: DataFrame) -> DistributionModel:
        return DistributionModel(*mixture.fit_mixture(df, self.n_components, self.seed))


@dataclass(eq=False)
class DistributionModel(_Fitted):
    means: Any
    covariances: Any

    def _transform(self, df: DataFrame) -> DataFrame:
        return mixture.cloud_vectors(df, self.means, self.covariances)

    def ground_distances(self):
        return mixture.ground_distances(self.means, self.covariances)


@dataclass(eq=False)
class CategoricalColumnTransformer(_Plain):
    object_column_name: str
    descriptor_columns: list[str]
    order_column: str
    include_column_name: bool = False
    unique_values: bool = False

    def _transform(self, df: DataFrame) -> DataFrame:
        return frames.categorical_lists(df, self.object_column_name, self.descriptor_columns, self.order_column, self.include_column_name, self.unique_values)


@dataclass(eq=False)
class SlidingWindowTransformer(_Plain):
    """Windows of series, through kernels if there are any: functions from a width to a matrix, which
    fold into one, or, from the first that is a function of a window's values on (`of_values`),
    functions applied to the values in turn."""

    window_width: int = 10
    window_stride: int = 1
    window_sample: list[int] | None = None
    kernels: list | None = None
    pad_width: int = 0
    pad_value: float = 0.0

    def _transform(self, df: DataFrame) -> DataFrame:
        out = series.sliding_windows(df, self.window_width, self.window_stride, self.window_sample, self.pad_width, self.pad_value)
        if not self.kernels:
            return out
        n = len(self.window_sample) if self.window_sample else self.window_width
        at = next((i for i, k in enumerate(self.kernels) if getattr(k, "of_values", False)), len(self.kernels))
        out = series.apply_kernel(out, series.fold(self.kernels[:at], n)) if at else out
        for k in self.kernels[at:]:
            out = series.apply_function(out.withColumn("points", F.col("values")) if "values" in out.columns else out, k)
        return out


@dataclass(eq=False)
class SequentialDifferenceTransformer(_Plain):
    stride: int = 1

    def _transform(self, df: DataFrame) -> DataFrame:
        return series.sequential_differences(df, self.stride)


@dataclass(eq=False)
class SignatureVectorizer(_Plain):
    truncation_level: int = 2
    log: bool = False
    basepoint: bool = False

    def _transform(self, df: DataFrame) -> DataFrame:
        return paths.signatures(df, self.truncation_level, self.log, self.basepoint)


@dataclass(eq=False)
class LZCompressionVectorizer(_Fit):
    max_dict_size: int = 1 << 16
    max_columns: int | None = 1 << 16
    base_dictionary: tuple[str, ...] = ()
    hash_function: Any = F.hash
    metric_ = "jaccard"

    def counts(self, df: DataFrame) -> DataFrame:
        return codecs.lz_counts(df, max_size=self.max_dict_size, known=self.base_dictionary)

    def _fit(self, df: DataFrame) -> LZModel:
        return LZModel(self, codecs.lz_matrix(self.counts(df), self.max_columns, self.hash_function)[0])


@dataclass(eq=False)
class LZModel(_Fitted):
    how: LZCompressionVectorizer
    columns: DataFrame | None

    def _transform(self, df: DataFrame) -> DataFrame:
        counts = self.how.counts(df)
        if self.columns is None:
            return codecs.lz_matrix(counts, self.how.max_columns, self.how.hash_function)[1]
        met = counts.join(self.columns, counts["phrase"] == self.columns["label"])
        return met.select(F.col("id").alias("row_id"), F.col("idx").alias("col_id"), F.col("n").cast("double").alias("value"))


@dataclass(eq=False)
class BytePairEncodingVectorizer(_Fit):
    max_vocab_size: int = 10_000
    min_token_occurrence: int = 1
    return_type: str = "matrix"
    max_char_code: str | int = "unicode"

    def _fit(self, df: DataFrame) -> BPEModel:
        if self.return_type not in ("matrix", "sequences", "tokens"):
            raise ValueError("the return type is matrix, sequences or tokens")
        merges = codecs.bpe_train(df, max_vocab=self.max_vocab_size, limit=self.max_char_code, min_count=self.min_token_occurrence)
        model = BPEModel(self, merges)
        model.columns = V.vocabulary(model.tokens(df))
        return model


@dataclass(eq=False)
class BPEModel(_Fitted):
    how: BytePairEncodingVectorizer
    merges: codecs.Merges
    columns: DataFrame | None = None

    def tokens(self, df: DataFrame) -> DataFrame:
        return S.tokens_of_arrays(codecs.bpe_encode(df, self.merges), "id")

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.how.return_type != "matrix":
            return codecs.bpe_encode(df, self.merges, tokens=self.how.return_type == "tokens")
        columns = self.columns.select(F.array("token").alias("label"), "idx")
        return grams.count_matrix(self.tokens(df).withColumn("gram", F.array("token")), columns)


@dataclass(eq=False)
class InformationWeightTransformer(_Fit):
    prior_strength: float = 1e-4
    approx_prior: bool = True
    weight_power: float = 2.0
    supervision_weight: float = 0.95
    labels: DataFrame | None = None

    def _fit(self, df: DataFrame) -> InformationWeightModel:
        return InformationWeightModel(weight.fit_information_weights(df, self.labels, self.prior_strength, self.approx_prior, self.weight_power, self.supervision_weight))


@dataclass(eq=False)
class InformationWeightModel(_Fitted):
    weights: DataFrame

    def _transform(self, df: DataFrame) -> DataFrame:
        return weight.weigh(df, self.weights)


@dataclass(eq=False)
class RowDenoisingTransformer(_Fit):
    em_precision: float = 1e-7
    em_background_prior: float = 1.0
    em_threshold: float = 1e-8
    em_prior_strength: float = 0.5
    normalize: bool = False

    def _fit(self, df: DataFrame) -> RowDenoisingModel:
        return RowDenoisingModel(self, df.groupBy("col_id").agg(F.sum("value").alias("mass")))


@dataclass(eq=False)
class RowDenoisingModel(_Fitted):
    how: RowDenoisingTransformer
    background: DataFrame

    def _transform(self, df: DataFrame) -> DataFrame:
        h = self.how
        return weight.denoise_rows(df, self.background, h.normalize, precision=h.em_precision, background_prior=h.em_background_prior, threshold=h.em_threshold, strength=h.em_prior_strength)


@dataclass(eq=False)
class CountFeatureCompressionTransformer(_Fit):
    n_components: int = 128
    rescaling_power: float = 0.5
    n_iter: int = 7
    seed: int = 0
    metric_ = "cosine"

    def _fit(self, df: DataFrame) -> CountFeatureCompressionModel:
        n = (df.agg(F.max("col_id")).first()[0] or 0) + 1
        return CountFeatureCompressionModel(self, linalg.compress_counts(df, n, self.n_components, self.rescaling_power, self.n_iter, self.seed)[0])


@dataclass(eq=False)
class CountFeatureCompressionModel(_Fitted):
    how: CountFeatureCompressionTransformer
    factors: linalg.Factors

    def _transform(self, df: DataFrame) -> DataFrame:
        return linalg.compress_with(df, self.factors, self.how.rescaling_power)


@dataclass(eq=False)
class WassersteinVectorizer(_Fit):
    """Distributions (row_id, weights, points) as vectors. method: exact, sinkhorn or mean, the
    last of which only averages: weighted sums over the row's mass to normalization_power, so
    that a power below 1 lets larger rows weigh more. Rows keep their max_distribution_size
    heaviest points. sketch: compress in one pass, see transport.compressed()."""

    method: str = "exact"
    n_components: int = 128
    reference_size: int | None = None
    reference_scale: float = 0.01
    metric: str = "cosine"
    seed: int = 42
    normalization_power: float = 1.0
    n_svd_iter: int = 7
    max_distribution_size: int = 256
    regularization: float = 0.05
    sketch: int | None = None

    def _fit(self, df: DataFrame) -> WassersteinModel:
        if self.method not in ("exact", "sinkhorn", "mean"):
            raise ValueError("the method is exact, sinkhorn or mean")
        df = transport.heaviest(df, self.max_distribution_size)
        ref = None if self.method == "mean" else transport.reference_of(df, self.reference_size, self.reference_scale, self.metric, self.seed)
        model = WassersteinModel(self, ref)
        model.factors = transport.compressed(model.raw(df), self.n_components, self.n_svd_iter, self.sketch)[0]
        return model


@dataclass(eq=False)
class WassersteinModel(_Fitted):
    how: WassersteinVectorizer
    reference: transport.Reference | None
    factors: linalg.Factors | None = None

    def raw(self, df: DataFrame) -> DataFrame:
        df = transport.heaviest(df, self.how.max_distribution_size)
        if self.reference is None:
            rows = df.select("row_id", F.explode(F.arrays_zip("weights", "points")).alias("e"))
            coo = rows.select("row_id", F.col("e.weights").alias("w"), F.posexplode("e.points").alias("i", "x"))
            sums = coo.groupBy("row_id", "i").agg((F.sum(F.col("w") * F.col("x")) / F.pow(F.sum("w"), F.lit(self.how.normalization_power))).alias("x"))
            return sums.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vec"))
        return transport.ot_vectors(df, self.reference, self.how.method, self.how.metric, self.how.regularization)

    def _transform(self, df: DataFrame) -> DataFrame:
        return linalg.project(self.raw(df).select("row_id", F.posexplode("vec").alias("col_id", "value")), self.factors)
