"""Operator 4: near-duplicates by SimHash, linked by exact tiled comparison.

Fingerprints are compared in tiles with exclusive-or and bit counts in numpy. The fingerprints of a tile are ordered by their
population count; a pair of sub-tiles whose counts differ by more than the radius holds no link and is skipped.

So that the work grows with the table and not with its square, tiles are formed within blocks: of r + m bit bands, two
fingerprints at distance r or less agree in at least m (pigeonhole), so comparing all pairs that agree in some m bands loses no
link. ``bands`` chooses m by the number of distinct fingerprints, so that a block holds about ``BLOCK`` of them at any size: up
to 17 million are keyed by any 1 of 5 bands (12 bits, 5 copies), up to 8 billion by any 2 of 6 (20 bits, 15 copies), beyond by
any 3 of 7 or 4 of 8 (27 and 32 bits). Fewer bits than these are used for fewer fingerprints; any number is exact. Blocks above
``TILE`` fingerprints are dealt into salted tiles and every tile pair is a group of its own, so no group is unbounded. A
tile pair gives a spanning forest of its links, never all pairs, and components are contracted in written rounds.

Cases: null and wordless texts have fingerprint zero and link like any other; fewer words than a shingle: one shingle of all
words. Equal fingerprints are one node however many rows have them. A null id takes part, but is never a component's id
unless all of its ids are null; ties do not arise, as the smallest id is unique. Repeated rows repeat in the result. Texts of any
length are read whole. An empty table gives an empty table. Extra columns are ignored, or kept by ``keep_first``, whatever they
are called.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelwave.llm.components import components
from voxelwave.llm.rows import bounded, pick, place, plain
from voxelwave.runtime import cut, ship

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints that one tile may hold, and that a block should hold.
TILE = 1 << 16
BLOCK = 1 << 12
#: Bands that agree in a key may be so many.
MAX_AGREE = 4
SUB_TILE = 2048

_LANES = np.array([sum(1 << 8 * j for j in range(8) if v >> j & 1) for v in range(256)], np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the values have each of the 64 bits: eight 8-bit counters are added at once, at most 255 times."""
    lanes = _LANES[h.view(np.uint8).reshape(-1, 8)]
    total = np.zeros((8, 8), np.int64)
    for at in range(0, len(h), 255):
        total += lanes[at : at + 255].sum(axis=0, dtype=np.uint64).view(np.uint8).reshape(8, 8)
    return total.reshape(64)


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    count = max(1, n - SHINGLE + 1)
    if n <= SHINGLE:
        starts, ends = [0], [len(joined)]
    else:
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = [0, *(spaces[: count - 1] + 1).tolist()]
        ends = [*spaces[SHINGLE - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], np.uint64)
        ones += bit_counts(h)
    bits = 2 * ones > count
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the unsigned fingerprint's bits as a signed long. Narrow."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return pick(df, id_col, text_col).toDF("id", "text").mapInArrow(run, f"id {kind}, fp long")


class Forest:
    """Components over 0..n-1 that take many links at once."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        fresh = a != b
        if not fresh.any():
            return
        pairs = np.unique(np.stack([np.minimum(a, b)[fresh], np.maximum(a, b)[fresh]], 1), axis=0)
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while x in up:
                if up[x] in up:
                    up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in pairs.tolist():
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        moved = np.arange(len(self.root))
        for x in up:
            moved[x] = find(x)
        self.root = moved[self.root]


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``left``, or between ``left`` and ``right`` (uint64, distinct)."""
    own = right is None
    right = left if own else right
    left, right = (x[np.argsort(np.bitwise_count(x), kind="stable")] for x in (left, right))
    lc, rc = (np.bitwise_count(x).astype(np.int16) for x in (left, right))
    nodes = left if own else np.concatenate([left, right])
    shift = 0 if own else len(left)
    forest = Forest(len(nodes))
    rows = 64
    for at in range(0, len(left), rows):
        part = left[at : at + rows, None]
        # sub-tiles whose population counts differ beyond the radius are skipped
        lo = int(np.searchsorted(rc, lc[at] - radius, "left"))
        hi = int(np.searchsorted(rc, lc[min(at + rows, len(left)) - 1] + radius, "right"))
        for to in range(max(lo, at) if own else lo, hi, SUB_TILE):
            i, j = np.nonzero(np.bitwise_count(part ^ right[None, to : min(to + SUB_TILE, hi)]) <= radius)
            if own:
                real = i + at != j + to
                i, j = i[real], j[real]
            if len(i):
                forest.link(i + at, j + to + shift)
    # each component as a star around its first node
    child = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return nodes[child], nodes[forest.root[child]]


def bands(n: int, radius: int, block: int) -> list[list[tuple[int, int]]]:
    """Keys for ``n`` fingerprints: each is a list of (lowest bit, bits) that together are its value.

    Bits are taken evenly from the bands of a key, only as many as leave about ``block`` fingerprints a value.
    """
    want = max(0, int(np.ceil(np.log2(max(n, 1) / block))))
    for agree in range(1, MAX_AGREE + 1):
        count = radius + agree
        bounds = [64 * k // count for k in range(count + 1)]
        width = min(b - a for a, b in zip(bounds, bounds[1:]))
        if agree * width >= want or agree == MAX_AGREE:
            break
    taken = min(want, agree * width)
    share = [taken * (i + 1) // agree - taken * i // agree for i in range(agree)]
    return [[(bounds[b], bits) for b, bits in zip(chosen, share)] for chosen in combinations(range(count), agree)]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct ``fp`` longs, a written table, to (u, v): edges whose components are those of all links at distance ``radius`` or less."""

    def value(parts: list[tuple[int, int]]) -> F.Column:
        key = F.lit(0).cast("long")
        for at, bits in parts:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
        return key

    keys = bands(fps.count(), radius, BLOCK)
    rows = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("band"), value(parts).alias("key")) for k, parts in enumerate(keys)))).alias("b")).select("fp", "b.band", "b.key")
    heavy = bounded(rows.groupBy("band", "key").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles")).where("tiles > 1"))
    dealt = rows.join(heavy, ["band", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles").cast("long")).cast("int"))
    pairs = dealt.select("band", "key", "fp", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).select(
        "band", "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") > F.col("other")).alias("second"), "fp"
    )

    def run(keys, t):
        _, _, i, j = (k.as_py() for k in keys)
        fp = t.column("fp").to_numpy().view(np.uint64)
        if i == j:
            a, b = tile_links(fp, None, radius)
        else:
            second = t.column("second").to_numpy()
            a, b = tile_links(fp[~second], fp[second], radius)
        return pa.table({"u": a.view(np.int64), "v": b.view(np.int64)})

    return pairs.groupBy("band", "key", "i", "j").applyInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    ship(df.sparkSession)
    prints = cut(fingerprints(df), "fingerprints")
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    named = cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = named.join(least, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of the smallest id of each component, with all columns; rows without an id stay."""
    first = near_duplicates(df, radius).where("doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
    rows, doc = plain(df), place(df, "doc_id")
    kept = rows.join(first.hint("shuffle_hash"), rows[doc] == F.col("first"), "left_semi")
    return kept.unionByName(rows.where(F.col(doc).isNull())).toDF(*df.columns)
