"""Shards of near-equal bytes by histogram sort, with DataFrame functions only.

Rows are ordered by a 53-bit hash of their key. Each round counts exact bytes below a grid of
candidate boundaries inside every splitter's open interval, in one grouped sum over a narrow
table, and narrows each interval to the grid cell that holds its target. When every splitter
meets the tolerance the rows are exchanged once, into cells of their shard; slots number the
rows in sorted order through exact cell counts, so no task ever holds a whole shard.

The place hashes the key with the text's length and crc32, so null and repeated keys spread over
all shards. Equal texts of different keys do not share a shard: the law promises equal bytes,
and a group of copies may be heavier than a shard.

Defined cases: a null text counts as empty (size 1, crc32 0); rows that are equal in key and
text have equal places, unless together they weigh more than 1 / SPREAD of a shard, when they
are dealt over all places; an empty table gives no rows; a row as heavy as several shards
leaves the shards beside it short, since a row is never divided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SPAN = 1 << 53
GRID = 64
#: Equal rows heavier than this part of a shard are dealt out.
SPREAD = 64


def place(*cols: Column) -> Column:
    """A uniform place in [0, 2^53) for a row, from its key."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11)


def _cells(bounds: list[tuple[int, int]], p: Column) -> Column:
    """Number of the grid cell of the open interval that holds p; cells of interval i start
    at i * (GRID + 1); what lies below interval i but above those before it is its cell 0."""
    out = F.lit(len(bounds) * (GRID + 1))
    for i, (lo, hi) in reversed(list(enumerate(bounds))):
        step = max(1, -(-(hi - lo) // GRID))
        cell = F.when(p < lo, F.lit(i * (GRID + 1))).otherwise((F.lit(i * (GRID + 1) + 1) + F.floor((p - lo) / step)).cast("int"))
        out = F.when(p < hi, cell).otherwise(out)
    return out.cast("int")


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.002) -> list[int]:
    """Places that cut `rows(p, size)` into shards whose bytes are within `tolerance` of equal,
    or as near as whole rows allow."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [total * i // shards for i in range(1, shards)]
    slack = max(1, int(total / shards * tolerance))
    lo, hi = [0] * (shards - 1), [SPAN] * (shards - 1)
    found: list[int | None] = [None] * (shards - 1)
    while any(x is None for x in found):
        # splitters that still share an interval share its counts
        open_ = sorted({(lo[i], hi[i]) for i in range(shards - 1) if found[i] is None})
        counts = dict(rows.groupBy(_cells(open_, F.col("p")).alias("cell")).agg(F.sum("size")).collect())
        below, edges = 0, {}
        for k, (a, b) in enumerate(open_):
            below += counts.get(k * (GRID + 1), 0)
            step = max(1, -(-(b - a) // GRID))
            edges[a, b] = [(a, below)]
            for g in range(GRID):
                below += counts.get(k * (GRID + 1) + 1 + g, 0)
                edges[a, b].append((min(b, a + (g + 1) * step), below))
        for i in range(shards - 1):
            if found[i] is None:
                at = edges[lo[i], hi[i]]
                best = min(at, key=lambda e: abs(e[1] - targets[i]))
                low = max((e for e in at if e[1] <= targets[i]), default=at[0])
                high = next((e for e in at if e[0] > low[0]), at[-1])
                if abs(best[1] - targets[i]) <= slack or high[0] - low[0] <= 1:
                    found[i] = best[0]
                else:
                    lo[i], hi[i] = low[0], high[0]
    for i in range(1, shards - 1):
        found[i] = max(found[i], found[i - 1])
    return found


def shard_rows(rows: DataFrame, cuts: list[int], rows_a_cell: int = 50_000) -> DataFrame:
    """Add shard and slot to `rows(p, ..)`; slots are gapless and follow (p, the other columns)."""
    edges = [0, *cuts, SPAN]
    shard, start, width = F.lit(0), F.lit(0), F.lit(max(1, edges[1]))
    for i in range(1, len(edges) - 1):
        at = F.col("p") >= edges[i]
        shard, start, width = (F.when(at, v).otherwise(o) for v, o in ((F.lit(i), shard), (F.lit(edges[i]), start), (F.lit(max(1, edges[i + 1] - edges[i])), width)))
    n = rows.count()
    cells = max(1, -(-n // (rows_a_cell * (len(edges) - 1))))
    out = rows.withColumns({"shard": shard.cast("int"), "__cell": F.floor((F.col("p") - start) / width * cells).cast("int")})
    sizes = out.groupBy("shard", "__cell").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    order = Window.partitionBy("shard", "__cell").orderBy("p", *[c for c in rows.columns if c != "p"])
    out = out.withColumn("__at", F.row_number().over(order)).join(sizes, ["shard", "__cell"])
    return out.withColumn("slot", (F.col("__before") + F.col("__at") - 1).cast("long")).drop("__cell", "__at", "__before")


def _placed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Add p, size and text_crc32: the place follows from key and text, null keys included."""
    body = F.coalesce(F.col(text), F.lit(""))
    crc = F.crc32(body.cast("binary"))
    return docs.withColumns({"p": place(F.col(key), F.length(body), crc), "size": F.octet_length(body).cast("long") + 1, "text_crc32": crc})


def _spread(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """rows(p, size, ..) with equal rows that weigh too much for one place dealt over all places,
    and these heavy places; there are at most SPREAD a shard. Rows of a place are alike, so which
    of them goes where does not matter."""
    most = (rows.agg(F.sum("size")).first()[0] or 0) / (shards * SPREAD)
    by_place = rows.groupBy("p").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
    heavy = materialize(by_place.where((F.col("w") > most) & (F.col("n") > 1)).select("p"), "heavy")
    return (rows, heavy) if heavy.isEmpty() else (materialize(_dealt(rows, heavy), "sizes"), heavy)


def _dealt(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    marked = rows.join(F.broadcast(heavy.select("p", F.lit(True).alias("__heavy"))), "p", "left")
    own = F.when(F.col("__heavy"), place(F.col("p"), F.monotonically_increasing_id())).otherwise(F.col("p"))
    return marked.withColumn("p", own).select(*rows.columns)


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, tolerance: float = 0.002) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    The law is `bytes`: a further shard moves the splitters, so grown_shard is null."""
    narrow = materialize(_placed(docs.select(key, text), key, text).select(key, "p", "size", "text_crc32"), "sizes")
    narrow, _ = _spread(narrow, shards)
    out = shard_rows(narrow, splitters(narrow, shards, tolerance))
    return out.select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = 8, files_a_shard: int = 1) -> None:
    """Write whole documents under path/shard=N, exchanging the texts once. An input column named
    shard is written as __shard."""
    docs = docs.withColumnRenamed("shard", "__shard")
    narrow, heavy = _spread(materialize(_placed(docs.select(key, text), key, text).select("p", "size"), "sizes"), shards)
    clash = {c: f"__own_{c}" for c in ("p", "size", "text_crc32") if c in docs.columns}
    names = {v: k for k, v in clash.items()}
    key, text = clash.get(key, key), clash.get(text, text)
    out = _dealt(_placed(docs.withColumnsRenamed(clash) if clash else docs, key, text), heavy)
    shard = F.lit(0)
    for i, cut in enumerate(splitters(narrow, shards), 1):
        shard = F.when(F.col("p") >= cut, F.lit(i)).otherwise(shard)
    out = out.withColumns({"__to": shard, "__p": F.col("p"), "__file": F.pmod(F.col("p"), F.lit(files_a_shard))}).drop("p", "size", "text_crc32")
    out = out.repartition(shards * files_a_shard, "__to", "__file").sortWithinPartitions("__to", "__p").drop("__p", "__file")
    out = out.withColumnsRenamed(names) if names else out
    out.withColumnRenamed("__to", "shard").write.partitionBy("shard").parquet(path)
