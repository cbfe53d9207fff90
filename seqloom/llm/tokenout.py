"""Token ids in shard files, with a minimal perfect hash index from document keys to offsets.

Files: a Parquet table of chunks (shard, chunk, first, payload, keys, lengths). A payload is the
raw little-endian unsigned 32-bit ids of consecutive documents in ascending key order, each
closed by the end id; `first` is the number of ids of the shard before it. Shards are ranges of
keys, one a task, and a chunk has about CHUNK_BYTES. Parquet is what any executor can write to
and read from any store that Spark reaches.

Index: entries, a key and an occurrence number each, are dealt by hash into buckets of about
BUCKET_KEYS. A bucket's minimal perfect hash
is a cascade of bit arrays: a key takes its slot at the first level where no other key of the
bucket hits its bit, and its rank there is its slot. Slots hold a 32-bit fingerprint, which
tells keys that were never indexed, and (shard, chunk, offset, length). A look-up is a
bounded number of probes, whatever the size of the data.

Defined cases: a null text encodes to the end id alone; a null key is a key of its own that
sorts first (as -2^63, which it is read as, so that no other key may be that number); rows of
one key stand in the order of their texts' xxhash64, may span shards, and are told apart by
their occurrence number; an empty table gives empty files and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import number_before, scratch_path
from .encoder import batches_of, encoder

CHUNK_BYTES, CHUNK_DOCS, BUCKET_KEYS, GAMMA, LEVELS = 4 << 20, 8192, 20_000, 2.0, 40
_CHUNK = "shard int, chunk int, first bigint, payload binary, keys array<bigint>, times array<bigint>, lengths array<bigint>"
_LONGS = pa.list_(pa.int64())
_CHUNK_ARROW = pa.schema({"shard": pa.int32(), "chunk": pa.int32(), "first": pa.int64(), "payload": pa.binary(), "keys": _LONGS, "times": _LONGS, "lengths": _LONGS})
_NULL_KEY = -(1 << 63)
#: Texts that are Python strings at once; a batch of Arrow holds the others.
_TEXTS = 512


def write_ids(docs: DataFrame, out: str, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text") -> None:
    """Write the files of docs under `out`."""
    key = F.coalesce(F.col(id).cast("long"), F.lit(_NULL_KEY)).alias("key")
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("key", "h").sortWithinPartitions("key", "h", "text").drop("h")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        chunk, first, size = 0, 0, 0
        held: list[tuple[int, int, bytes]] = []
        last, times = None, 0

        def flush() -> pa.RecordBatch:
            keys, seen, bodies = zip(*held, strict=True)
            row = [shard, chunk, first, b"".join(bodies), keys, seen, [len(b) // 4 for b in bodies]]
            return pa.RecordBatch.from_pylist([dict(zip(_CHUNK_ARROW.names, row, strict=True))], _CHUNK_ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                some = batch.slice(at, _TEXTS).to_pydict()
                keys, texts = some["key"], some["text"]
                for a, b in batches_of(texts, 2_000_000):
                    for key, ids in zip(keys[a:b], enc.encode(texts[a:b]), strict=True):
                        times = times + 1 if key == last else 0
                        last = key
                        held.append((key, times, ids + end))
                        size += len(ids) + 4
                        if size >= CHUNK_BYTES or len(held) >= CHUNK_DOCS:
                            yield flush()
                            chunk, first, size = chunk + 1, first + size // 4, 0
                            held.clear()
        if held:
            yield flush()

    rows.mapInArrow(encode, _CHUNK).write.parquet(out)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of the files, with `start`: all ids before the chunk's first."""
    chunks = spark.read.schema(_CHUNK).parquet(path)
    sizes = chunks.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    # one row a shard; shards are tasks, so this is a few thousand rows at any size of data
    before = number_before(sizes, "shard", "n", "before").select("shard", "before")
    return chunks.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("first")).drop("before")


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_code(keys: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A 64-bit code of key and occurrence; distinct keys that occur once never share one."""
    return _mix(keys.astype(np.int64).view(np.uint64), 1) + times.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def build_mphf(codes: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of the levels, for distinct codes."""
    levels, rest = [], codes
    while len(rest):
        if len(levels) == LEVELS:
            raise ValueError("two keys of a bucket share a code")
        m = max(64, int(GAMMA * len(rest)))
        at = (_mix(rest, 100 + len(levels)) % np.uint64(m)).astype(np.int64)
        hits = np.bincount(at, minlength=m)
        levels.append(hits == 1)
        rest = rest[hits[at] != 1]
    return levels


def slots(levels: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Slot of each code, 0 to n - 1; for codes never built in, -1 or the slot of another."""
    out, base, open_ = np.full(len(codes), -1, dtype=np.int64), 0, np.arange(len(codes))
    for k, bits in enumerate(levels):
        at = (_mix(codes[open_], 100 + k) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        out[open_[hit]] = base + (np.cumsum(bits) - 1)[at[hit]]
        open_, base = open_[~hit], base + int(bits.sum())
    return out


def _check(codes: np.ndarray) -> np.ndarray:
    return (_mix(codes, 7) >> np.uint64(32)).astype(np.int64)


def _bucket(n: int):
    return F.pmod(F.xxhash64("key", "times"), F.lit(n)).cast("int")


def _earlier(chunks: DataFrame) -> DataFrame:
    """(shard, key, earlier): how often a shard's first key occurs in the shards before it. Only
    first keys can continue, so this is a row a shard at most."""
    first = chunks.groupBy("shard").agg(F.min(F.get("keys", F.lit(0))).alias("key"))
    counts = chunks.select("shard", F.explode("keys").alias("key")).join(F.broadcast(first.select("key").distinct()), "key", "left_semi").groupBy("key", "shard").agg(F.count("*").alias("n"))
    w = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("shard", "key", F.sum("n").over(w).alias("earlier")).where(F.col("earlier") > 0)


_INDEX = "bucket int, buckets int, sizes array<int>, bits binary, checks array<bigint>, shards array<int>, chunks array<int>, offsets array<bigint>, lengths array<bigint>"


def write_index(spark: SparkSession, path: str, out: str) -> None:
    """Build the index of the files at `path`; a row a bucket. Reads no payload."""
    chunks = spark.read.schema(_CHUNK).parquet(path)
    n = chunks.agg(F.sum(F.size("keys"))).first()[0] or 0
    buckets = max(1, -(-n // BUCKET_KEYS))

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for r in df.itertuples(index=False):
                size = np.asarray(r.lengths, dtype=np.int64)
                yield pd.DataFrame({"key": r.keys, "times": r.times, "shard": r.shard, "chunk": r.chunk, "at": np.cumsum(size) - size, "n": size})

    rows = chunks.select("shard", "chunk", "keys", "times", "lengths").mapInPandas(entries, "key bigint, times bigint, shard int, chunk int, at bigint, n bigint")
    rows = rows.join(F.broadcast(_earlier(chunks)), ["shard", "key"], "left").withColumn("times", F.col("times") + F.coalesce("earlier", F.lit(0))).drop("earlier")

    def build(df: pd.DataFrame) -> pd.DataFrame:
        codes = key_code(df["key"].to_numpy(), df["times"].to_numpy())
        levels = build_mphf(codes)
        order = np.empty(len(df), dtype=np.int64)
        order[slots(levels, codes)] = np.arange(len(df))
        df, codes = df.iloc[order], codes[order]
        return pd.DataFrame({
            "bucket": [int(df["bucket"].iloc[0])], "buckets": [buckets], "sizes": [[len(x) for x in levels]],
            "bits": [np.packbits(np.concatenate(levels)).tobytes()], "checks": [_check(codes)], "shards": [df["shard"].to_numpy()],
            "chunks": [df["chunk"].to_numpy()], "offsets": [df["at"].to_numpy()], "lengths": [df["n"].to_numpy()],
        })

    rows.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(build, _INDEX).write.parquet(out)


def find(keys: DataFrame, index: DataFrame) -> DataFrame:
    """keys(key, times) -> (key, times, shard, chunk, offset, n); keys that are not in the files
    give no row. A bucket's keys meet its index row in one task."""
    head = index.select("buckets").first()
    schema = "key bigint, times bigint, shard int, chunk int, offset bigint, n bigint"
    if head is None:
        return keys.sparkSession.createDataFrame([], schema)

    def look_up(key, df: pd.DataFrame, row: pd.DataFrame) -> pd.DataFrame:
        if df.empty or row.empty:
            return pd.DataFrame(columns=["key", "times", "shard", "chunk", "offset", "n"])
        r = row.iloc[0]
        bits = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8))[: int(sum(r["sizes"]))].astype(bool)
        levels = np.split(bits, np.cumsum(r["sizes"])[:-1])
        codes = key_code(df["key"].to_numpy(), df["times"].to_numpy())
        at = slots(levels, codes)
        ok = (at >= 0) & (np.asarray(r["checks"])[np.maximum(at, 0)] == _check(codes))
        df, at = df[["key", "times"]][ok], at[ok]
        take = lambda c: np.asarray(r[c])[at]
        return df.assign(shard=take("shards"), chunk=take("chunks"), offset=take("offsets"), n=take("lengths"))

    keyed = keys.withColumn("bucket", _bucket(head["buckets"]))
    return keyed.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(look_up, schema)


def fetch(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of what find() returned. The tasks that scan the payloads
    hash each document where it lies, so places and digests are shuffled and payloads are not."""

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for r in df.itertuples(index=False):
                body, n = memoryview(r.payload), np.asarray(r.lengths, dtype=np.int64)
                at = np.cumsum(n) - n
                crc = [zlib.crc32(body[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                yield pd.DataFrame({"shard": r.shard, "chunk": r.chunk, "offset": at, "n_tokens": n, "start": r.start + at, "ids_crc32": crc})

    places = chunks.select("shard", "chunk", "start", "payload", "lengths").mapInPandas(digest, "shard int, chunk int, offset bigint, n_tokens bigint, start bigint, ids_crc32 bigint")
    met = found.select("key", "shard", "chunk", "offset", F.col("n").alias("n_tokens")).join(places, ["shard", "chunk", "offset", "n_tokens"])
    return met.select("key", "start", "n_tokens", "ids_crc32")


def get(spark: SparkSession, path: str, keys: list[int], most: int = 10_000) -> dict[int, list[int]]:
    """Ids of the first document of each of a few keys, by the index: only the buckets of the keys
    and the chunks that hold them are read. Keys that are not there are left out."""
    if len(keys) > most:
        raise ValueError(f"more than {most} keys: use find() and the chunks")
    index = spark.read.schema(_INDEX).parquet(f"{path}/index")
    head = index.select("buckets").first()
    if head is None or not keys:
        return {}
    wanted = spark.createDataFrame([(k, 0) for k in keys], "key bigint, times bigint")
    buckets = [r[0] for r in wanted.select(_bucket(head["buckets"])).distinct().collect()]
    found = find(wanted, index.where(F.col("bucket").isin(buckets))).collect()
    chunks = spark.read.schema(_CHUNK).parquet(f"{path}/files")
    out = {}
    at = {(r["shard"], r["chunk"]) for r in found}
    held = chunks.where(F.struct("shard", "chunk").isin([F.struct(F.lit(s).alias("shard"), F.lit(c).alias("chunk")) for s, c in at])) if at else chunks.limit(0)
    bodies = {(r["shard"], r["chunk"]): r["payload"] for r in held.select("shard", "chunk", "payload").toLocalIterator()}
    for r in found:
        a = 4 * r["offset"]
        out[r["key"]] = np.frombuffer(bytes(bodies[r["shard"], r["chunk"]][a : a + 4 * r["n"]]), "<u4").tolist()
    return out


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, id: str = "doc_id", text: str = "text", out: str | None = None) -> DataFrame:
    """Write files and index of docs, then read every document back by its key:
    (id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    out = out or scratch_path(spark, "ids")
    write_ids(docs, f"{out}/files", tokenizer, end_id, id, text)
    write_index(spark, f"{out}/files", f"{out}/index")
    key = F.coalesce(F.col(id).cast("long"), F.lit(_NULL_KEY)).alias("key")
    # every occurrence of every key, numbered without gathering the rows of a key
    entries = docs.select(key).groupBy("key").agg(F.count("*").alias("n"))
    found = find(entries.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("times")), spark.read.schema(_INDEX).parquet(f"{out}/index"))
    rows = fetch(found, read_ids(spark, f"{out}/files"))
    return rows.select(F.when(F.col("key") != _NULL_KEY, F.col("key")).alias(id), "start", "n_tokens", "ids_crc32")
