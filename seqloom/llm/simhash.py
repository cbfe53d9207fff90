"""SimHash near-duplicates by multi-index hashing.

A fingerprint is an array of 64-bit longs cut into segments. If the segments' ball radii r_i
satisfy sum(r_i + 1) > d, two fingerprints within distance d agree in some segment up to its
radius, so a look-up of every value in each segment's ball finds all links, which the complete
distance then verifies. With larger d the same search is a filter of high recall,
and with `overlap` an exact count of shared shingles follows it.

Scale: equal fingerprints collapse first (their documents point at the least doc_id). Balls
are enumerated on the probing side only. A bucket that more than `HOT` fingerprints share is
not joined: its rows go, in blocks against blocks, to Arrow tasks that compare all of them and
return only a spanning forest of the links. Nothing is capped and no pair list of a group is
ever made; components need the forest only.

Defined cases: null and empty texts have fingerprint zero; fewer words than a shingle make one
shingle of them all; repeated rows give repeated rows; a null doc_id is in no component and
gets component_id null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .components import components

HOT, BLOCK, BLOCK_LONGS = 48, 1024, 1 << 20
#: Hashes whose bits are unpacked at once; with several longs, as many as a sum of bytes can hold.
_UNPACK_AT_ONCE, _SUM_AT_ONCE = 1 << 16, 255
_EPS = 1e-6


@dataclass(frozen=True)
class SimHash:
    """words: words a shingle; longs: 64-bit parts of a fingerprint; segment_bits and radii:
    the index; distance: the largest that links. With overlap, a fingerprint is that of the
    distinct shingles; pairs that the index finds are dropped where their last longs differ in
    more than `distance` bits, and link if their sets of shingles of overlap_words words
    overlap (shared over all) by at least that, counted for each pair. The last long is then in
    no segment, and a digest and the size of the set of shingles follow the fingerprint."""

    words: int = 3
    longs: int = 1
    segment_bits: tuple[int, ...] = (32, 32)
    radii: tuple[int, ...] = (1, 0)
    distance: int = 2
    overlap: float = 0.0
    overlap_words: int = 5
    #: Fingerprints in a bucket beyond which it is compared in blocks (None: HOT).
    hot: int | None = None

    @property
    def exact(self) -> bool:
        """Whether the shingles themselves decide, not the fingerprints."""
        return self.overlap > 0


def _bit_sums(h: np.ndarray) -> np.ndarray:
    """Sums of each of the 64 bits, highest first, over hashes."""
    out = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), _UNPACK_AT_ONCE):
        bits = np.unpackbits(h[i : i + _UNPACK_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out += bits.sum(axis=0, dtype=np.int64)
    return out


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Further hashes from the first, by the splitmix64 finaliser."""
    h = h + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, how: SimHash) -> list[int]:
    """Unsigned longs of a text; a bit is 1 if it is set in over half the hashes."""
    words = _words(text)
    if not words:
        return [0] * (how.longs + 2 * how.exact)
    if not how.exact:
        return _longs(_hashes(words, how.words), how.longs)
    each = _word_hashes(words)
    prints, sets = (np.unique(_joined(each, n)) for n in (how.words, how.overlap_words))
    return [*_signs(prints, how.longs), xxhash.xxh64_intdigest(sets.tobytes(), 42), len(sets)]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hashes(words: list[bytes], n: int) -> np.ndarray:
    """A hash of each shingle of n words."""
    return np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))], dtype=np.uint64)


def _longs(first: np.ndarray, longs: int) -> list[int]:
    of = lambda k: np.packbits(_bit_sums(first if k == 0 else _mixed(first, k)) * 2 > len(first)).tobytes()
    return [int.from_bytes(of(k), "big") for k in range(longs)]


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], dtype=np.uint64)


def _joined(each: np.ndarray, n: int) -> np.ndarray:
    """A hash of each shingle of n words from the hashes of its words, in their order."""
    n = min(n, len(each))
    out = np.zeros(len(each) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = _mixed(out ^ each[k : k + len(out)], k + 1)
    return out


def _signs(distinct: np.ndarray, longs: int) -> list[int]:
    """A fingerprint of distinct shingle hashes, each hashed anew for each long."""
    salts = _mixed(np.arange(1, longs + 1, dtype=np.uint64), 1)
    sums = np.zeros(64 * longs, dtype=np.int64)
    for i in range(0, len(distinct), _SUM_AT_ONCE):
        h = _mixed(distinct[i : i + _SUM_AT_ONCE, None] ^ salts, 2).astype(">u8")
        sums += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(sums * 2 > len(distinct)).view(">u8").tolist()


def with_fingerprints(docs: DataFrame, how: SimHash, text: str = "text", out: str = "fp") -> DataFrame:
    """Add `fp`, an array of longs (bit patterns of the unsigned ones)."""

    @F.pandas_udf("array<bigint>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.array(fingerprint(t, how), dtype=np.uint64).view(np.int64) for t in texts], dtype=object)

    return docs.withColumn(out, of(F.col(text)))


def _with_shingles(docs: DataFrame, how: SimHash) -> DataFrame:
    """Add `shingles`, the distinct hashes of the shingles of `text` in ascending order."""

    @F.pandas_udf("array<bigint>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(_joined(_word_hashes(w), how.overlap_words).view(np.int64)) if (w := _words(t)) else [] for t in texts], dtype=object)

    return docs.withColumn("shingles", of("text"))


def _segments(how: SimHash) -> list[tuple[int, int, int, int]]:
    """(long, shift, bits, radius) of each segment, from the highest bits on."""
    out, at = [], 0
    for bits, radius in zip(how.segment_bits, how.radii, strict=True):
        if at // 64 != (at + bits - 1) // 64:
            at = -(-at // 64) * 64
        out.append((at // 64, 64 - at % 64 - bits, bits, radius))
        at += bits
    return out


def _value(fp: Column, segment: tuple[int, int, int, int]) -> Column:
    long, shift, bits, _ = segment
    if bits == 64:
        return fp[long]
    return F.shiftrightunsigned(fp[long], shift).bitwiseAND(F.lit((1 << bits) - 1))


def _flips(segment: int, value: Column, bits: int) -> Column:
    """Probes for the values that differ from `value` in one bit, which is 0 in it."""
    unset = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.getbit(value, b) == 0)
    flipped = lambda b: value.bitwiseOR(F.pow(F.lit(2.0), b).cast("long"))
    return F.transform(unset, lambda b: F.struct(F.lit(segment).alias("seg"), flipped(b).alias("v"), F.lit(True).alias("probe")))


def _keys(fps: DataFrame, how: SimHash) -> DataFrame:
    """Rows (seg, v, id, probe): each fingerprint once in each segment's table, and a probe for
    each other value of its ball. Of two values at distance 1 only the one whose bit is 0
    probes, which finds the pair once. With how.exact, `last` is the last long and `size` the
    number of distinct shingles."""
    fp, rows = F.col("fp"), []
    for i, seg in enumerate(_segments(how)):
        value = _value(fp, seg)
        rows.append(F.array(F.struct(F.lit(i).alias("seg"), value.alias("v"), F.lit(False).alias("probe"))))
        for r in range(1, seg[3] + 1):
            if r > 1:
                raise ValueError("segment radii are 0 or 1")
            rows.append(_flips(i, value, seg[2]))
    more = {"last": fp[how.longs - 1], "size": fp[how.longs + 1]} if how.exact else {}
    keys = fps.select("id", *[c.alias(k) for k, c in more.items()], F.explode(F.flatten(F.array(*rows))).alias("k"))
    return keys.select("id", "k.seg", "k.v", "k.probe", *more)


def _distance(a: str, b: str, how: SimHash) -> Column:
    parts = [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(how.longs)]
    return sum(parts[1:], parts[0])


def _linked(a: str, b: str, how: SimHash) -> Column:
    """Whether two fingerprints, or with how.exact two sets of shingles, link."""
    if not how.exact:
        return _distance(a, b, how) <= how.distance
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(small >= how.overlap * large - _EPS, shared >= how.overlap * (small + large - shared) - _EPS).otherwise(False)


def spanning_forest(ids_a: np.ndarray, ids_b: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges, at most one fewer than the nodes, that connect whatever the links between the
    two blocks connect. linked(i, js): which rows js of b link with row i of a; rows that are
    connected already are not asked for again."""
    nodes, at = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
    at_a, at_b = at[: len(ids_a)], at[len(ids_a) :]
    group = np.arange(len(nodes))
    edges = []
    for i, x in enumerate(at_a):
        js = np.flatnonzero(group[at_b] != group[x])
        for j in js[linked(i, js)] if len(js) else ():
            if group[at_b[j]] != group[x]:
                group[group == group[at_b[j]]] = group[x]
                edges.append((int(ids_a[i]), int(ids_b[j])))
    return edges


def _near(fps_a: np.ndarray, fps_b: np.ndarray, distance: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Links of fingerprints, (n, longs) of uint64."""
    return lambda i, js: np.bitwise_count(fps_b[js] ^ fps_a[i]).sum(axis=1, dtype=np.int64) <= distance


def _overlapping(sets_a: list[np.ndarray], sets_b: list[np.ndarray], overlap: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Links of sets of shingles, each ascending."""
    size_a, size_b = (np.array([len(x) for x in sets]) for sets in (sets_a, sets_b))

    def linked(i: int, js: np.ndarray) -> np.ndarray:
        small, large = np.minimum(size_a[i], size_b[js]), np.maximum(size_a[i], size_b[js])
        out = small >= overlap * large - _EPS
        kept = js[out]
        if len(kept):
            every = np.concatenate([sets_b[j] for j in kept])
            mine = sets_a[i]
            hit = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
            shared = np.add.reduceat(hit, np.cumsum(size_b[kept]) - size_b[kept], dtype=np.int64)
            out[out] = shared >= overlap * (size_a[i] + size_b[kept] - shared) - _EPS
        return out

    return linked


def _blocks(longs: Column) -> list[Column]:
    """Sums over a bucket: `own` and `foreign`, the numbers of blocks of its table rows and of its
    probes, each row with so many longs to compare."""
    count = lambda c: (F.count_if(c), F.sum(F.when(c, longs).otherwise(0)))
    # hashing deals unevenly, so more than one block are planned three quarters full
    part = lambda n, most: F.when(n <= most, F.lit(1)).otherwise(F.ceil(n * 4 / (3 * most)))
    number = lambda c: F.greatest(part(count(c)[0], BLOCK), part(count(c)[1], BLOCK_LONGS)).cast("int")
    return [number(~F.col("probe")).alias("own"), number(F.col("probe")).alias("foreign")]


def _cells(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(seg, v, id, probe, of) of hot buckets -> the two sides of their cells, (seg, v,
    probes, i, j, id, of). Table rows and probes are dealt into blocks of their own, by their own
    counts; a cell is two blocks of table rows, or one of table rows and one of probes. A block
    has at most about BLOCK rows and BLOCK_LONGS longs, unless a single row has more. The numbers
    of blocks are counted here unless the rows have them."""
    probe = F.col("probe")
    if "own" not in rows.columns:
        rows = rows.join(rows.groupBy("seg", "v").agg(*_blocks(F.size("of"))), ["seg", "v"])
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda first, last: F.sequence(F.lit(first) if isinstance(first, int) else first, last)
    cell = lambda probes, i, j: F.struct(F.lit(probes).alias("probes"), i.alias("i"), j.alias("j"))
    left = F.concat(
        F.transform(upto(at("own"), F.col("own") - 1), lambda j: cell(False, at("own"), j)),
        F.transform(upto(0, F.col("foreign") - 1), lambda j: cell(True, at("own"), j)),
    )
    right = F.when(probe, F.transform(upto(0, F.col("own") - 1), lambda i: cell(True, i, at("foreign")))).otherwise(
        F.transform(upto(0, at("own")), lambda i: cell(False, i, at("own")))
    )
    side = lambda df, cells: df.select("seg", "v", "id", "of", F.explode(cells).alias("c")).select("seg", "v", "c.*", "id", "of")
    return side(rows.where(~probe), left), side(rows, right)


def _hot_links(hot_keys: DataFrame, nodes: DataFrame, how: SimHash) -> DataFrame:
    """hot_keys(seg, v, id, probe, own, foreign): all rows of the hot buckets. nodes(id, of): what
    decides a link."""
    # both sides read these rows, which are joined once
    left, right = _cells(materialize(hot_keys.join(nodes, "id").select("seg", "v", "id", "probe", "own", "foreign", "of"), "hot"))

    def compare(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        if how.exact:
            linked = _overlapping(a["of"].tolist(), b["of"].tolist(), how.overlap)
        else:
            fp = lambda x: np.array(x["of"].tolist(), dtype=np.int64).view(np.uint64).reshape(len(x), -1)
            linked = _near(fp(a), fp(b), how.distance)
        edges = spanning_forest(a["id"].to_numpy(), b["id"].to_numpy(), linked)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    by = ["seg", "v", "probes", "i", "j"]
    left, right = (x.select(*[F.col(c).alias(c) for c in (*by, "id", "of")]) for x in (left, right))
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(compare, "a bigint, b bigint")


def links(fps: DataFrame, how: SimHash, texts: DataFrame | None = None) -> DataFrame:
    """fps(id BIGINT, fp), fingerprints distinct -> edges (a, b) whose components are those of
    all links; outside hot buckets every link within reach of the index is itself an edge.
    With how.exact, fps has text_hash too, the xxhash64 of a row of texts(text), and only texts
    that meet another are read again for their shingles."""
    # with many segments they are taken from the fingerprints twice rather than written
    keys = _keys(fps, how) if how.exact else materialize(_keys(fps, how), "segments")
    # a bucket of one row has no pair: only rows of the others are exchanged again; they take the
    # numbers of blocks along, so that rows of hot buckets need not be counted and joined anew
    sizes = keys.groupBy("seg", "v").agg(F.count("*").alias("rows"), F.count_if(~F.col("probe")).alias("n"), *_blocks(F.col("size") if how.exact else F.lit(how.longs)))
    sizes = materialize(sizes.where((F.col("rows") > 1) & (F.col("n") > 0)).drop("rows"), "buckets")
    shared = materialize(keys.drop("size").join(sizes, ["seg", "v"]), "shared")
    release(keys, sizes)
    hot = F.col("n") > (HOT if how.hot is None else how.hot)
    hot_keys, cool = shared.where(hot).drop("n"), shared.where(~hot).drop("n", "own", "foreign")
    any_hot = not hot_keys.isEmpty()
    side = lambda df, end, *more: df.select("seg", "v", F.col("id").alias(end), *more, *[F.col("last").alias(f"last_{end}")] * how.exact)
    met = side(cool.where(~F.col("probe")), "a").join(side(cool, "b", "probe"), ["seg", "v"])
    if how.exact:
        met = met.where(F.bit_count(F.col("last_a").bitwiseXOR(F.col("last_b"))) <= how.distance)
    pairs = met.where((F.col("a") != F.col("b")) & (F.col("probe") | (F.col("a") < F.col("b")))).select("a", "b")
    if len(how.segment_bits) > 2:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    nodes = fps.select("id", F.col("fp").alias("of"))
    if how.exact:
        pairs = materialize(pairs, "pairs")
        met_ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
        met_ids = (met_ids.union(hot_keys.select("id")) if any_hot else met_ids).distinct()
        wanted = fps.join(met_ids, "id").select("id", "text_hash")
        sets = _with_shingles(texts.select("text", F.xxhash64("text").alias("text_hash")).join(wanted, "text_hash"), how)
        nodes = materialize(sets.groupBy("id").agg(F.first("shingles").alias("of")), "shingles")
    of = lambda end: nodes.select(F.col("id").alias(end), F.col("of").alias(f"of_{end}"))
    out = pairs.join(of("a"), "a").join(of("b"), "b").where(_linked("of_a", "of_b", how)).select("a", "b")
    if any_hot:
        out = out.union(_hot_links(hot_keys, nodes, how))
    return out


def near_duplicates(docs: DataFrame, how: SimHash = SimHash(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row of docs: the fingerprint, and the smallest id
    reachable over links of at most how.distance differing bits, itself included."""
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = materialize(with_fingerprints(texts, how).select("id", "fp", F.xxhash64("text").alias("text_hash")), "fingerprints")
    fps = materialize(rows.where(F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("id"), F.min("text_hash").alias("text_hash")), "distinct")
    node = F.xxhash64("fp") if how.longs > 1 else F.col("fp")[0]
    found = components(links(fps.select(node.alias("id"), "fp", "text_hash"), how, texts))
    label = fps.withColumn("node", node).join(found, "node", "left")
    label = label.withColumn("component", F.coalesce("component", "node"))
    least = label.groupBy("component").agg(F.min("id").alias("component_id"))
    named = label.join(least, "component").select("fp", "component_id")
    out = rows.join(named, "fp", "left")
    return out.select(F.col("id").alias(id), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


#: The pipeline stage: fingerprints of 33 longs of the distinct two-word shingles, which an edit
#: alters less than those of five words. The index is of 64 segments of 24 bits, so pairs that
#: differ in 63 or fewer of these 1,536 bits share one for certain, others by chance: of pairs that
#: differ in a twelfth of the bits (a word of 60 changed) one in 4,700 shares none, in a tenth one
#: in 200, in an eighth one in 14. Each link is an overlap of five-word shingles of at least 0.8,
#: counted. Of unlike texts that share a segment one in 500 has a last long within 20 bits; the
#: others are not counted. A group of near copies meets in many segments, so buckets of more
#: than 8 already give a spanning forest.
STAGE = SimHash(words=2, longs=33, segment_bits=(24,) * 64, radii=(0,) * 64, distance=20, overlap=0.8, hot=8)


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
