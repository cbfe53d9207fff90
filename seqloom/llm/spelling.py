"""Spelling variants: words one edit apart, and the frequent form that each rarer one stands for.

Words one insertion, deletion or replacement apart agree in half of their letters, at the start
or at the end: of the m letters of the shorter one, a replacement leaves a common half of
floor(m / 2) and an insertion one of ceil(m / 2). The vocabulary is therefore written as two
sorted dictionaries, of the words and of the reversed words. A block is a stretch of one of
them: words of m or m + 1 letters that share their first (or last) half. Blocks of more than
BLOCK words are subdivided by the same rule, applied to what their words do not share yet:
half of that rest is intact too, at its start or at its end. A rest that has no half left
bounds its block by the alphabet. Tasks scan ranges of the sorted blocks and verify each
neighbour by its common start and end.

Size: texts are exploded into words that are counted before they are shuffled; all that follows
works on distinct words. A block in memory has at most BLOCK words, or those that differ in one
letter of the same place. Chains of forms are followed by pointer doubling.

Defined cases: a null text has no words; a null id is an empty text where ids are hashed; repeated
rows count each; an empty table gives no rows; of forms with equal counts the smallest in
code-point order is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, release

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LETTERS, MIN_COUNT, TIMES, BLOCK, SPOIL = 6, 5, 5, 64, 199


def words_of(docs: DataFrame, id: str = "doc_id", text: str = "text", run: str = RUN, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, spoil: int = SPOIL) -> DataFrame:
    """(word, n) of whole texts: lower-cased runs of letters; where `spoil` divides the hash of id and
    run, the run loses a letter. spoil = 0 leaves all runs as they are."""
    runs = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(run), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= min_letters)
    word = F.col("run")
    if spoil:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = F.pmod(h, F.char_length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        word = F.when(h % spoil == 0, cut).otherwise(word)
    words = runs.select(word.alias("word")).where(F.char_length("word") >= min_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in its two next blocks, of a shared start and of a shared end. `m` is the length of
    the shorter words, `a` and `b` the letters shared so far, `path` the halves taken."""
    length, long = F.char_length("word"), F.char_length("word") - F.col("m")
    rest = F.col("m") - F.col("a") - F.col("b")
    half = F.when(F.col("kind") == 1, F.ceil(rest / 2)).otherwise(F.floor(rest / 2)).cast("int")
    start = F.struct(F.lit("s").alias("side"), (F.col("a") + half).alias("a"), F.col("b").alias("b"))
    end = F.struct(F.lit("e").alias("side"), F.col("a").alias("a"), (F.col("b") + half).alias("b"))
    out = rows.withColumn("x", F.explode(F.array(start, end))).drop("a", "b")
    out = out.select("word", "m", "kind", F.concat("path", "x.side").alias("path"), "x.a", "x.b")
    return out.withColumns({"long": long, "head": F.substring("word", F.lit(1), F.col("a")), "tail": F.reverse(F.substring("word", length - F.col("b") + 1, F.col("b")))})


#: Columns that name a block, in the order of the dictionaries: reversed words share their `tail`.
KEY = ["kind", "m", "path", "head", "tail"]


def _blocks(words: DataFrame) -> DataFrame:
    """The rows of blocks that may hold neighbours, none larger than BLOCK but those that the
    alphabet bounds."""
    length = F.char_length("word")
    # kind 0: a replacement among words of m letters; kind 1: a letter more, m + 1 beside m
    roles = F.array(
        F.struct(F.lit(0).alias("kind"), length.alias("m")), F.struct(F.lit(1).alias("kind"), length.alias("m")), F.struct(F.lit(1).alias("kind"), (length - 1).alias("m"))
    )
    rows = words.select("word", F.explode(roles).alias("r")).select("word", "r.kind", "r.m", F.lit("").alias("path"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    done = None
    while True:
        rows = materialize(_halves(rows), "halves")
        sizes = rows.groupBy(*KEY).agg(F.count("*").alias("rows"), F.count_if(F.col("long") == 1).alias("longs"))
        # one word alone has no neighbour, nor have words of one role where two are needed
        met = sizes.where((F.col("rows") > 1) & ((F.col("kind") == 0) | ((F.col("longs") > 0) & (F.col("longs") < F.col("rows")))))
        rest = F.col("m") - F.length("head") - F.length("tail")
        met = materialize(met.withColumn("split", (F.col("rows") > BLOCK) & (rest > 1 - F.col("kind"))), "blocks")
        kept = rows.join(met.select(*KEY, "split"), KEY)
        small = materialize(kept.where(~F.col("split")).select("word", "long", *KEY), "small")
        done = small if done is None else done.unionByName(small)
        if met.where("split").isEmpty():
            return done
        rows = kept.where("split").select("word", "m", "kind", "path", "a", "b")


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and the letters of words from their start and from their end, padded."""
    n = np.array([len(w) for w in words])
    width = int(n.max())
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row, at = np.repeat(np.arange(len(words)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    left, right = np.zeros((len(words), width), np.uint32), np.zeros((len(words), width), np.uint32)
    left[row, at] = flat
    right[row, n[row] - 1 - at] = flat
    return n, left, right


def _common(x: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common start of rows i and j of x."""
    differ = np.hstack([x[i] != x[j], np.ones((len(i), 1), bool)])
    return np.minimum(differ.argmax(axis=1), most)


def near(letters: tuple[np.ndarray, np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i and j are exactly one edit apart."""
    n, left, right = letters
    m, gap = np.minimum(n[i], n[j]), np.abs(n[i] - n[j])
    shared = _common(left, i, j, m) + _common(right, i, j, m)
    return ((gap == 0) & (shared == m - 1)) | ((gap == 1) & (shared >= m))


def _neighbours(df: pd.DataFrame) -> pd.DataFrame:
    """Pairs one edit apart within blocks, which follow one another: rows are compared with those
    1, 2, ... places on, as long as any are in the same block."""
    found = []
    # blocks of words of like length share an array
    for _, rows in df.groupby(np.ceil(np.log2((df["word"].str.len() - df["long"]).clip(lower=8)))):
        words, block, kind, long = (rows[c].to_numpy() for c in ("word", "block", "kind", "long"))
        letters, step = _letters(list(words)), 1
        while True:
            i = np.flatnonzero(block[step:] == block[:-step])
            if not len(i):
                break
            i = i[(kind[i] == 0) | (long[i] != long[i + step])]
            i = i[near(letters, i, i + step)]
            found.append(pd.DataFrame({"u": words[i], "v": words[i + step]}))
            step += 1
    return pd.concat(found) if found else pd.DataFrame({"u": [], "v": []}, dtype=str)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Neighbours in a range of the sorted dictionaries; the last block of a batch may go on."""
    held = None
    for df in batches:
        df = df if held is None else pd.concat([held, df], ignore_index=True)
        last = df["block"].to_numpy() == df["block"].iloc[-1] if len(df) else np.zeros(0, bool)
        # a block is unbroken: only its rows at the end are held back
        start = len(df) - int(np.argmin(last[::-1])) if len(df) and not last.all() else 0
        held = df.iloc[start:]
        if start:
            yield _neighbours(df.iloc[:start])
    if held is not None and len(held):
        yield _neighbours(held)


def neighbours(words: DataFrame) -> DataFrame:
    """(u, v): the pairs of distinct words one edit apart, once, in either order."""
    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _blocks(words).repartitionByRange(partitions, *KEY).sortWithinPartitions(*KEY, "word")
    pairs = rows.select("word", "kind", "long", F.xxhash64(*KEY).alias("block")).mapInPandas(_scan, "u string, v string")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _roots(links: DataFrame) -> DataFrame:
    """links(word, form) -> (word, root): each link becomes the link of its end, until none moves."""
    state = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ends = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(state.join(ends, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(state)
        state = moved
        if state.where("moved").isEmpty():
            return state.select("word", "root")


def variants(words: DataFrame, times: float = TIMES) -> DataFrame:
    """words(word, n) -> word, form, root, n, n_near, form_n: the words one edit apart are counted;
    the form is the most frequent of them if it is `times` as frequent as the word, and the root
    the end of the chain of forms."""
    pairs = neighbours(words)
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = both.join(words.select(F.col("word").alias("v"), "n"), "v")
    best = met.groupBy(F.col("u").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("k"), "v")).alias("best"))
    form = F.when(-F.col("best.k") >= times * F.col("n"), F.col("best.v"))
    out = words.join(best, "word", "left").select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.k")).alias("k"))
    out = materialize(out.withColumn("form_n", F.when(F.col("form").isNotNull(), F.col("k"))).drop("k"), "forms")
    roots = _roots(out.where(F.col("form").isNotNull()))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, id: str = "doc_id", text: str = "text", times: float = TIMES, **how) -> DataFrame:
    """The words of docs with their forms and roots, see words_of() and variants()."""
    return variants(materialize(words_of(docs, id, text, **how), "words"), times)
