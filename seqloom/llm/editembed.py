"""Fingerprints by randomised edit embedding.

A walk over the characters of a text writes out, step by step, the character it stands on, and a
random bit of (step, character), the same for all texts, says whether it moves on. Texts at
small edit distance then agree at most steps: after an edit their walks soon fall in step
again, so edit distance becomes Hamming distance. A walk of n characters takes about 2n steps.

The fingerprint keeps the characters of sampled steps. Steps are sampled by a hash at a rate
2^-level, where level follows from the text's length and the samples of a level include those
of the next, so fingerprints of texts of different lengths compare on the coarser level.
Likeness is the share of samples, up to the end of the longer walk, that agree.

Near-duplicates: bands of sampled bits (the samples of one level at fixed places) propose pairs,
and the full likeness verifies them.

The walks of many texts advance together as numpy lanes, a step of the loop a character.

Defined cases: null and empty texts have the fingerprint of no samples and likeness 1 with each
other, 0 with any other text; rows with equal ids stand in descending order of their texts'
xxhash64; a null id is the lowest and stays null; a table of one row is its own next document;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components
from .simhash import spanning_forest

SAMPLES, PERIOD, SEED = 128, 4096, 11
_LANE_CHARS = 3_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _moves(seed: int = SEED) -> np.ndarray:
    """Steps that the walk spends on a character class from each step on, (class, step) flat."""
    c, j = np.meshgrid(np.arange(256, dtype=np.uint64), np.arange(PERIOD, dtype=np.uint64), indexing="ij")
    go = (_mix(c * np.uint64(0x9E3779B97F4A7C15) + j * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)) >> np.uint64(17)) & np.uint64(1)
    wait = np.zeros((256, 2 * PERIOD), dtype=np.int32)
    wait[:, -1] = 1
    twice = np.hstack([go, go])
    for k in range(2 * PERIOD - 2, -1, -1):
        wait[:, k] = np.where(twice[:, k] == 1, 1, wait[:, k + 1] + 1)
    return np.ascontiguousarray(wait[:, :PERIOD]).ravel()


def _classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    return (_mix(points + np.uint64(0x51ED27)) & np.uint64(0xFF)).astype(np.int32)


@lru_cache(maxsize=64)
def _sampled(level: int, upto: int) -> np.ndarray:
    """Steps below `upto` that the level samples."""
    steps = np.arange(upto, dtype=np.uint64)
    return np.flatnonzero(_mix(steps + np.uint64(0xABCDEF)) >> np.uint64(64 - level) == 0) if level else np.arange(upto)


def level_of(n: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, 2 * n) / SAMPLES))))


def walk(texts: list[np.ndarray], start: np.ndarray | None = None, seed: int = SEED) -> list[np.ndarray]:
    """For each text (character classes) the step at which the walk reaches each character, and
    the step after the last; start: the step of each walk's first character."""
    moves, out = _moves(seed), [None] * len(texts)
    start = np.zeros(len(texts), dtype=np.int64) if start is None else start
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        # lanes of like length: a matrix no more than half empty
        longest = len(texts[order[at]])
        end = at + 1
        while end < len(order) and 2 * len(texts[order[end]]) >= longest and (end - at + 1) * longest <= _LANE_CHARS:
            end += 1
        lanes = order[at:end]
        chars = np.zeros((longest, len(lanes)), dtype=np.int32)
        for k, i in enumerate(lanes):
            chars[: len(texts[i]), k] = texts[i]
        chars *= PERIOD
        j = start[lanes].copy()
        steps = np.empty((longest + 1, len(lanes)), dtype=np.int64)
        steps[0] = j
        for row in range(longest):
            j = j + moves[chars[row] + (j & (PERIOD - 1))]
            steps[row + 1] = j
        for k, i in enumerate(lanes):
            out[i] = steps[: len(texts[i]) + 1, k].copy()
        at = end
    return out


def sample(chars: np.ndarray, steps: np.ndarray) -> str:
    """`level:end:samples`, in hexadecimal, two digits a sampled character."""
    end, level = int(steps[-1]), level_of(len(chars))
    grid = _sampled(level, 1 << max(8, int(np.ceil(np.log2(end + 1)))))
    at = grid[: np.searchsorted(grid, end)]
    body = chars[np.searchsorted(steps, at, side="right") - 1].astype(np.uint8).tobytes().hex() if len(chars) else ""
    return f"{level:x}:{end:x}:{body}"


def parsed(fingerprint: str) -> tuple[int, int, np.ndarray]:
    """Level, end and sampled characters."""
    level, end, body = fingerprint.split(":")
    return int(level, 16), int(end, 16), np.frombuffer(bytes.fromhex(body), np.uint8)


def _on(print_: tuple[int, int, np.ndarray], level: int) -> np.ndarray:
    """The samples that a coarser level shares."""
    own, end, x = print_
    if own == level:
        return x
    upto = 1 << max(8, int(np.ceil(np.log2(end + 1))))
    return x[np.isin(_sampled(own, upto)[: len(x)], _sampled(level, upto), assume_unique=True)]


def likeness_of(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    level = max(a[0], b[0])
    xa, xb = _on(a, level), _on(b, level)
    n, most = min(len(xa), len(xb)), max(len(xa), len(xb))
    return round(float(np.count_nonzero(xa[:n] == xb[:n])) / most, 9) if most else 0.0


def likeness(a: str, b: str) -> float:
    return 1.0 if a == b else likeness_of(parsed(a), parsed(b))


def fingerprints(texts: list[str], seed: int = SEED) -> list[str]:
    chars = [_classes(t) for t in texts]
    return [sample(c, s) for c, s in zip(chars, walk(chars, seed=seed), strict=True)]


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", seed: int = SEED) -> DataFrame:
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        found: list[str] = []
        for a, b in _some([t or "" for t in texts]):
            found += fingerprints([t or "" for t in texts[a:b]], seed)
        return pd.Series(found)

    return docs.withColumn(out, of(F.col(text)))


def _some(texts: list[str], limit: int = 1_500_000):
    from .encoder import batches_of

    return batches_of(texts, limit)


#: Characters of a bucket, and ids that are sampled to place the borders of buckets.
BUCKET_CHARS, BORDER_SAMPLE = 2_000_000, 200_000
_KEY = ["no_id", "id", "h"]


def with_neighbours(docs: DataFrame, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """docs(no_id, id, text): add h, bucket and guest. In descending order of (id, h), h a hash of
    the text, each bucket holds a run of documents, and as guests the documents that follow
    its last. One exchange of the texts. There are a few buckets a task, so that tasks even out,
    and at most BORDER_SAMPLE; what the driver holds is one border and one top key a bucket,
    and at most BORDER_SAMPLE sampled keys, which place the borders and do not change results."""
    docs = docs.withColumn("h", F.xxhash64("text"))
    keys = materialize(docs.select(*_KEY, F.length("text").alias("n")), "keys")
    rows, chars = keys.agg(F.count("*"), F.sum("n")).first()
    if not rows:
        return docs.withColumns({"bucket": F.lit(0), "guest": F.lit(False)})
    count = max(1, -(-chars // bucket_chars))
    some = keys if rows <= BORDER_SAMPLE else keys.sample(min(1.0, min(20 * count, BORDER_SAMPLE) / rows), 3)
    points = sorted((not r[0], r[1], r[2]) for r in some.select(*_KEY).collect()) if count > 1 else []
    cuts = sorted({points[len(points) * i // count] for i in range(1, count)}) if points else []
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(cuts)
    place = lambda no_id, id, h: [bisect_left(shared.value, key) for key in zip((~no_id).tolist(), id.tolist(), h.tolist(), strict=True)]

    @F.pandas_udf("int")
    def bucket_of(no_id: pd.Series, id: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(place(no_id, id, h), dtype="int32")

    order = F.struct((~F.col("no_id")).alias("has"), "id", "h")
    tops = {r["bucket"]: r["top"] for r in keys.groupBy(bucket_of(*_KEY).alias("bucket")).agg(F.max(order).alias("top")).collect()}
    used = sorted(tops)
    # the documents with a bucket's top key follow the bucket above; the topmost follow the lowest
    above = {(b, tuple(tops[b])): used[(k + 1) % len(used)] for k, b in enumerate(used)}
    sent = spark.sparkContext.broadcast(above)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One guest of each bucket is enough from a task: those with a top key have one text."""
        done = set()
        for df in frames:
            at = place(df["no_id"], df["id"], df["h"])
            yield df.assign(bucket=np.array(at, dtype=np.int32), guest=False)
            for i, key in enumerate(zip(at, zip((~df["no_id"]).tolist(), df["id"].tolist(), df["h"].tolist(), strict=True), strict=True)):
                if key in sent.value and key not in done:
                    done.add(key)
                    yield df.iloc[[i]].assign(bucket=np.int32(sent.value[key]), guest=True)

    return docs.select("no_id", "id", "text", "h").mapInPandas(deal, "no_id boolean, id bigint, text string, h bigint, bucket int, guest boolean")


_COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "banded_edited", "banded_next"]
_OUT = "no_id boolean, id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, banded_edited boolean, banded_next boolean"


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """Each document and its edited text: the last floor(n/2) characters replaced by the first as
    many (or all) of the next document in descending id; after the last comes the first.
    near_* are likenesses, banded_* whether the two fingerprints share a band and so would
    be a candidate pair of near_duplicates()."""
    key = F.col(id).cast("long")
    base = docs.select(key.isNull().alias("no_id"), F.coalesce(key, F.lit(0)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["bucket", "guest", "no_id", F.desc("id"), F.desc("h"), "text"]
    rows = with_neighbours(base, bucket_chars).repartition("bucket").sortWithinPartitions(*order)
    out = rows.select("bucket", "guest", "no_id", "id", "text").mapInPandas(_edited, _OUT)
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias(id), *_COLUMNS)


def _edited(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a bucket come in order, its guests last; a row is done once the next is known."""
    held: list[tuple] = []
    size = 0
    for df in frames:
        for row in zip(df["bucket"].tolist(), df["text"].tolist(), df["guest"].tolist(), df["no_id"].tolist(), df["id"].tolist(), strict=True):
            held.append(row)
            size += len(row[1])
            if size > 1_500_000:
                yield _pairs(held)
                held, size = held[-1:], len(row[1])
    if held:
        yield _pairs(held)


def _pairs(rows: list[tuple]) -> pd.DataFrame:
    """Results of all rows but the last (whose result comes with what follows it) and guests."""
    chars = [_classes(r[1]) for r in rows]
    steps = walk(chars)
    prints = [sample(c, s) for c, s in zip(chars, steps, strict=True)]
    bands = [set(_bands(p)) for p in prints]
    todo = [i for i in range(len(rows) - 1) if not rows[i][2] and rows[i + 1][0] == rows[i][0]]
    tails, starts = [], []
    for i in todo:
        half = len(chars[i]) // 2
        tails.append(chars[i + 1][:half])
        starts.append(steps[i][len(chars[i]) - half])
    ends = walk(tails, np.array(starts, dtype=np.int64))
    out = []
    for i, tail, end in zip(todo, tails, ends, strict=True):
        text, n = rows[i][1], len(chars[i])
        half = n // 2
        edited = text[: n - half] + rows[i + 1][1][:half]
        fp = sample(np.concatenate([chars[i][: n - half], tail]), np.concatenate([steps[i][: n - half], end]))
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        near = likeness(prints[i], fp), likeness(prints[i], prints[i + 1])
        met = not bands[i].isdisjoint(_bands(fp)), not bands[i].isdisjoint(bands[i + 1])
        out.append((*rows[i][3:], n, sha, prints[i], fp, *near, *met))
    return pd.DataFrame(out, columns=["no_id", "id", *_COLUMNS])


#: Walks that an edit throws off for long are the embedding's rare failures; independent ones
#: seldom fail for the same pair.
WALKS = 3
BANDS, BAND_SAMPLES, HOT, BLOCK = 24, 4, 48, 256


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """(id, class_id) for every row with an id: texts are linked whose likeness in any of WALKS
    walks is at least `least` and who share one of its BANDS bands of bit-sampled places;
    class_id is the least id reachable. Equal texts are one class from the start; bands that
    more than HOT texts share are compared in blocks, which return a spanning forest."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(docs.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.xxhash64(body).alias("node"), body.alias("text")), "texts")
    ids = rows.groupBy("node").agg(F.min("id").alias("id"))
    texts = rows.select("node", "text").dropDuplicates(["node"])
    edges = None
    for k in range(WALKS):
        prints = materialize(with_fingerprints(texts, seed=SEED + k).select("node", "fingerprint"), "prints")
        found = _linked(prints, least)
        edges = found if edges is None else edges.union(found)
    named = ids.join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    label = named.groupBy("component").agg(F.min("id").alias("class_id"))
    named = named.join(label, "component").select("node", "class_id")
    return rows.join(named, "node").select(F.col("id").alias(id), "class_id")


def _linked(prints: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of prints(node, fingerprint)."""

    @F.pandas_udf("array<bigint>")
    def bands(prints: pd.Series) -> pd.Series:
        return pd.Series([_bands(p) for p in prints], dtype=object)

    keys = materialize(prints.select("node", "fingerprint", F.explode(F.array_distinct(bands("fingerprint"))).alias("v")), "bands")
    hot = materialize(keys.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "hot")
    cool = keys.join(hot, "v", "left_anti")
    end = lambda k: cool.select("v", F.col("node").alias(k), F.col("fingerprint").alias(f"f{k}"))
    pairs = end("a").join(end("b"), "v").where(F.col("a") < F.col("b")).drop("v").distinct()

    @F.pandas_udf("double")
    def like(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(p, q) for p, q in zip(x, y, strict=True)])

    edges = pairs.where(like("fa", "fb") >= least).select("a", "b")
    return edges.union(_hot_links(keys.join(hot, "v"), least))


def _hot_links(rows: DataFrame, least: float) -> DataFrame:
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumns({"own": F.pmod(F.col("node"), blocks).cast("int"), "blocks": blocks})
    left = rows.select("v", "node", "fingerprint", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    right = rows.select("v", "node", "fingerprint", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"))
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))

    def compare(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        pa, pb = ([parsed(p) for p in x["fingerprint"]] for x in (a, b))
        linked = lambda i, js: np.array([likeness_of(pa[i], pb[j]) >= least for j in js], dtype=bool)
        edges = spanning_forest(a["node"].to_numpy(), b["node"].to_numpy(), linked)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    by = ["v", "i", "j"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(compare, "a bigint, b bigint")


@lru_cache(maxsize=64)
def _places(level: int) -> np.ndarray:
    """The samples that each band of a level reads."""
    return np.random.default_rng(level).integers(0, SAMPLES // 2, (BANDS, BAND_SAMPLES))


def _bands(fingerprint: str) -> list[int]:
    """Keys of level, band and sampled bits. A text also shows the bands of the next coarser level,
    to meet those just above a border; a text without samples has the key -1."""
    found = parsed(fingerprint)
    if not len(found[2]):
        return [-1]
    out = []
    for level in (found[0], found[0] + 1):
        y = np.zeros(SAMPLES // 2, dtype=np.uint8)
        x = _on(found, level)[: SAMPLES // 2]
        y[: len(x)] = x
        bits = y[_places(level)].view("<u4").ravel().astype(np.int64)
        out += (bits + ((level * BANDS + np.arange(BANDS)) << 32)).tolist()
    return out
