"""Language identification by interpolated Kneser-Ney models of characters, one a language.

A text is folded to lower-case letters and marks; whatever lies between is one blank. Runs of
ORDER characters are counted a language; lower orders count in how many kinds of longer runs a
run ends, as Kneser and Ney have it. With an absolute discount D an order and language,

    p(c | ctx) = max(count(ctx c) - D, 0) / total(ctx) + D * kinds(ctx) / total(ctx) * p(c | shorter ctx)

and below the first order all characters seen, and one for the rest, are equally likely. A model
is a few sorted arrays of hashes beside their shares or back-off weights. The language of a text
is the one of the lowest cross-entropy a character.

Rejection is calibrated on labelled documents that the models did not learn from, a tenth of
them: the score is the chance that the choice is right, an isotonic fit of the lead over the
second language; a text is accepted if that reaches ACCEPT and its cross-entropy is not above what
all but a thousandth of the texts of its language have.

Size: every labelled document is counted, by batches whose counts are summed before and after the
exchange. Hashes have BITS bits, so a model has at most 2^BITS entries an order and kind however
large the corpus; where two runs share a hash the larger value holds. Languages are taken in
blocks of at most MAX_ENTRIES entries (or one language), and each block is a pass.
Documents are folded in pieces, so a long one is held once. The driver holds one block and
a row a language.

Defined cases: a null text, and one without letters, is `und` with score 0; a null id is neither
held out nor learnt from; documents without a language are not learnt from; repeated rows count
each; of languages with equal cross-entropy the first in code-point order is taken; if nothing was
learnt all are `und`.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release
from .quality import isotonic

ORDER, BITS, MAX_ENTRIES = 4, 22, 1 << 24
PAD, BLANK, PIECE = 2, 32, 1 << 21
HELD_OUT, CALIBRATE, GRID, ACCEPT, TAIL, UNKNOWN = 5, 10, 1000, 0.5, 0.999, "und"
_MULTIPLIER, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What each code point folds to, and whether it is a letter."""
    fold, letter = np.full(0x110000, BLANK, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            fold[c], letter[c] = ord(low) if len(low) == 1 else c, kind == "L"
    return fold, letter


def folded(text: str, context: int = ORDER - 1) -> Iterator[tuple[np.ndarray, bool]]:
    """The folded text in pieces, each after its context, and whether the piece has a letter."""
    fold, letter = _tables()
    before, last = np.full(context, PAD, np.uint32), BLANK
    for lo in range(0, len(text), PIECE):
        raw = np.frombuffer(text[lo : lo + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        x = fold[raw]
        keep = (x != BLANK) | (np.concatenate([[last], x[:-1]]) != BLANK)
        last, x = x[-1], np.concatenate([before, x[keep]])
        before = x[len(x) - context :]
        yield x, bool(letter[raw].any())


def _chunks(texts: Iterator[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in chunks of about PIECE characters: all characters, the ends of runs in them, the
    text of each, and the texts with a letter."""
    held, owner, size, lettered = [], [], 0, []

    def joined():
        n = np.array([len(x) for x in held])
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ends = np.flatnonzero(at >= ORDER - 1)
        return np.concatenate(held), ends, np.repeat(owner, n)[ends], np.array(lettered, dtype=np.int64)

    for k, text in enumerate(texts):
        for x, found in folded(text) if text else ():
            held.append(x)
            owner.append(k)
            lettered += [k] if found else []
            size += len(x)
            if size >= PIECE:
                yield joined()
                held, owner, size, lettered = [], [], 0, []
    if held:
        yield joined()


def _kinds(chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of ORDER characters, a row each, and which of them ends at each end."""
    with np.errstate(over="ignore"):
        key = np.zeros(len(ends), np.uint64)
        for j in range(ORDER):
            key = key * np.uint64(_MULTIPLIER) + chars[ends - (ORDER - 1 - j)]
    which, kinds = pd.factorize(key)
    first = np.empty(len(kinds), np.int64)
    first[which[::-1]] = ends[::-1]
    return chars[first[:, None] + np.arange(1 - ORDER, 1)], which


def slots(runs: np.ndarray) -> np.ndarray:
    """Hashes of BITS bits of runs of characters, a row each."""
    with np.errstate(over="ignore"):
        h = np.full(len(runs), runs.shape[1] + 1, np.uint64)
        for j in range(runs.shape[1]):
            h = (h ^ runs[:, j].astype(np.uint64)) * np.uint64(_MULTIPLIER)
            h ^= h >> np.uint64(29)
        h *= np.uint64(_MIX)
    return (h >> np.uint64(64 - BITS)).astype(np.uint32)


def run_counts(train: DataFrame) -> DataFrame:
    """train(lang, text) -> (lang, run, n): how often each run of ORDER characters occurs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for lang, texts in df.groupby("lang")["text"]:
                for chars, ends, _, _ in _chunks(texts):
                    if len(ends):
                        runs, which = _kinds(chars, ends)
                        names = np.ascontiguousarray(runs.astype("<u4")).view(f"<U{ORDER}").ravel()
                        yield pd.DataFrame({"lang": lang, "run": names.astype(object), "n": np.bincount(which)})

    return train.select("lang", "text").mapInPandas(count, "lang string, run string, n bigint").groupBy("lang", "run").agg(F.sum("n").alias("n"))


def _slot(run: pd.Series) -> pd.Series:
    out = np.zeros(len(run), np.int32)
    for n, at in run.groupby(run.str.len()).groups.items():
        codes = np.frombuffer("".join(run[at]).encode("utf-32-le"), np.uint32)
        out[at] = slots(codes.reshape(len(at), n)).astype(np.int32)
    return pd.Series(out)


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, run, n) -> (lang, size, kind, slot, value): kind 0 are shares of runs of `size`
    characters, kind 1 back-off weights of contexts of runs of that size, kind 2 the equal
    chance below."""
    at = counts.select("lang", F.lit(ORDER).alias("size"), "run", "n")
    orders = at
    for n in range(ORDER - 1, 0, -1):
        at = materialize(at.groupBy("lang", F.substring("run", 2, n).alias("run")).agg(F.count("*").alias("n")), "runs").select("lang", F.lit(n).alias("size"), "run", "n")
        orders = orders.unionByName(at)
    orders = orders.withColumn("context", F.substring("run", F.lit(1), F.col("size") - 1))
    once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    discount = F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5)
    discounts = orders.groupBy("lang", "size").agg(discount.alias("d"))
    totals = orders.groupBy("lang", "size", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(discounts, ["lang", "size"])
    totals = materialize(totals, "contexts")
    shares = orders.join(totals, ["lang", "size", "context"]).select("lang", "size", F.lit(0).alias("kind"), "run", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("value"))
    weights = totals.select("lang", "size", F.lit(1).alias("kind"), F.col("context").alias("run"), (F.col("d") * F.col("kinds") / F.col("total")).alias("value"))
    equal = totals.where(F.col("size") == 1).select("lang", "size", F.lit(2).alias("kind"), F.lit("").alias("run"), (1 / (F.col("kinds") + 1)).alias("value"))
    rows = shares.unionByName(weights).unionByName(equal).withColumn("slot", F.pandas_udf(_slot, "int")("run"))
    return rows.groupBy("lang", "size", "kind", "slot").agg(F.max("value").alias("value"))


class Model:
    """One language: sorted hashes and their values by kind and size."""

    def __init__(self, rows: pd.DataFrame):
        self.equal = float(rows.loc[rows["kind"] == 2, "value"].iloc[0])
        self.arrays = {}
        for key, part in rows.groupby(["kind", "size"]):
            part = part.sort_values("slot")
            self.arrays[key] = part["slot"].to_numpy().astype(np.uint32), part["value"].to_numpy()

    def _value(self, kind: int, size: int, at: np.ndarray, default: float) -> np.ndarray:
        known, value = self.arrays[kind, size]
        place = np.minimum(np.searchsorted(known, at), len(known) - 1)
        return np.where(known[place] == at, value[place], default)

    def chances(self, hashes: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
        """p of the last character of each run, from the hashes of its ends and their contexts."""
        p = self.equal
        for n in range(1, ORDER + 1):
            p = self._value(0, n, hashes[0, n], 0.0) + self._value(1, n, hashes[1, n], 1.0) * p
        return p


def hashes_of(runs: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    return {(kind, n): slots(runs[:, ORDER - n : ORDER - kind]) for kind in (0, 1) for n in range(1, ORDER + 1)}


def cross_entropies(texts: pd.Series, models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each text (0 without a letter), and its cross-entropy by each model."""
    n, sums, lettered = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(models))), np.zeros(len(texts), bool)
    for chars, ends, owner, found in _chunks(texts):
        lettered[found] = True
        if not len(ends):
            continue
        runs, which = _kinds(chars, ends)
        hashes = hashes_of(runs)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        n[owner[first]] += np.diff([*first, len(owner)])
        for k, model in enumerate(models):
            sums[owner[first], k] += np.add.reduceat(-np.log(model.chances(hashes))[which], first)
    n[~lettered] = 0
    return n, sums / np.maximum(n, 1)[:, None]


def _crc(id: str) -> Column:
    return F.crc32(F.col(id).cast("string").cast("binary"))


def held_out(id: str = "doc_id") -> Column:
    """True for the documents that may not be learnt from."""
    return F.coalesce(_crc(id) % HELD_OUT == 0, F.lit(False))


def fit(train: DataFrame) -> DataFrame:
    """The models of train(lang, text), a table."""
    return materialize(kneser_ney(materialize(run_counts(train), "counts")), "models")


def _blocks(models: DataFrame) -> list[list[str]]:
    """Languages in order, in blocks of at most MAX_ENTRIES entries."""
    out, size = [], MAX_ENTRIES + 1
    for r in models.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect():
        if size + r["n"] > MAX_ENTRIES:
            out.append([])
            size = 0
        out[-1].append(r["lang"])
        size += r["n"]
    return out


def _entropies(shared) -> Callable:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n, h = cross_entropies(texts, shared.value)
            yield pd.DataFrame({"n": n, "h": list(h)})

    return run


def _scored(spark: SparkSession, rows: DataFrame, models: DataFrame, blocks: list[list[str]]) -> DataFrame:
    """Add `n`, and `h`, the cross-entropies by language, to rows(id, text, ..); text goes."""
    rows = rows.withColumns({"n": F.lit(0).cast("bigint"), "h": F.array().cast("array<double>")})
    for number, langs in enumerate(blocks):
        held = models.where(F.col("lang").isin(langs)).toArrow().to_pandas()
        parts = dict(list(held.groupby("lang")))
        shared = spark.sparkContext.broadcast([Model(parts[x]) for x in langs])

        found = F.pandas_udf(_entropies(shared), "n bigint, h array<double>")("text")
        before, rows = rows, rows.withColumn("found", found).withColumns({"n": F.col("found.n"), "h": F.concat("h", "found.h")}).drop("found")
        rows = materialize(rows if number < len(blocks) - 1 else rows.drop("text"), "entropies")
        shared.destroy()
        release(before)
    return rows


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", accept: float = ACCEPT, reject: bool = False) -> DataFrame:
    """(id, held_out, lang_pred, score, accepted, entropy) for every row of docs; with `reject`, texts
    that are not accepted are `und` too."""
    spark, fold = docs.sparkSession, F.floor(_crc("id") / HELD_OUT) % CALIBRATE
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    known = F.col("lang").isNotNull() & (_crc("id") % HELD_OUT != 0)
    models = fit(rows.where(known & (fold != 0)))
    blocks = _blocks(models)
    langs = [x for block in blocks for x in block]
    if not langs:
        return rows.select(F.col("id").alias(id), held_out("id").alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("entropy"))
    rows = _scored(spark, rows, models, blocks)
    best, order = F.array_min("h"), F.array_sort("h")
    lead = F.when(F.size("h") > 1, (F.get(order, F.lit(1)) - best) * F.sqrt(F.col("n"))).otherwise(0.0)
    choice = F.get(F.array(*[F.lit(x) for x in langs]), (F.array_position("h", best) - 1).cast("int"))
    rows = rows.withColumns({"choice": F.when(F.col("n") > 0, choice), "entropy": F.when(F.col("n") > 0, best), "lead": lead / (1 + lead)})
    tried = rows.where(known & (fold == 0) & F.col("choice").isNotNull())
    right = F.avg((F.col("choice") == F.col("lang")).cast("double"))
    bins = tried.groupBy(F.floor(F.col("lead") * GRID).alias("bin")).agg(right.alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    x, y = isotonic(np.array([(r["bin"] + 0.5) / GRID for r in bins]), np.array([r["y"] for r in bins]), np.array([r["n"] for r in bins], dtype=float)) if bins else (np.zeros(1), np.full(1, 0.5))

    @F.pandas_udf("double")
    def chance(lead: pd.Series) -> pd.Series:
        # a small slope keeps the order of leads within the steps of the fit
        return pd.Series(np.round(0.99 * np.interp(lead, x, y) + 0.01 * lead, 9))

    tails = tried.where(F.col("choice") == F.col("lang")).groupBy("choice").agg(F.percentile_approx("entropy", TAIL, 10_000).alias("tail")).collect()
    tail = F.lit(float("inf"))
    for r in tails:
        tail = F.when(F.col("choice") == r["choice"], F.lit(r["tail"])).otherwise(tail)
    rows = rows.withColumn("score", F.when(F.col("choice").isNotNull(), chance("lead")).otherwise(0.0))
    accepted = F.col("choice").isNotNull() & (F.col("score") >= accept) & (F.col("entropy") <= tail)
    pred = F.when(F.col("accepted"), F.col("choice")).otherwise(UNKNOWN) if reject else F.coalesce("choice", F.lit(UNKNOWN))
    return rows.withColumn("accepted", accepted).select(F.col("id").alias(id), held_out("id").alias("held_out"), pred.alias("lang_pred"), "score", "accepted", "entropy")
