"""Operator 6: best-fit packing of token pieces into sequences.

A bounded-space online best-fit: a fixed number of open bins, held in a bitset keyed by free space. A piece goes to the open
bin with the least free space that holds it; if none does and all places are taken, the fullest open bin closes. Pieces of a
group arrive longest first. Groups are dealt by a hash of the piece and its place, so each is of bounded size, equal rows spread
over all groups, and none depends on another.

Cases: null and empty texts are the end token alone. A document of more than ``capacity`` tokens is cut into pieces of the
capacity, the first taking the rest. Repeated rows and null ids are packed like any others. An empty table packs to an empty
table. Pieces of equal length keep the order of their group's table. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelwave.llm.bpe import library_ids
from voxelwave.llm.rows import pick
from voxelwave.runtime import cut, ship

CAPACITY = 2048
OPEN_BINS = 1024
#: Pieces that one packing group should hold.
GROUP = 4096


def pieces(df: DataFrame, vocab: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: token ids with the end token, cut to the capacity. Narrow."""
    ship(df.sparkSession)
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches):
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for r, raw in enumerate(library_ids(vocab, b.column(1).to_pylist())):
                raw += end
                n = len(raw) // 4
                first = (n - 1) % capacity + 1
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    to = first if k == 0 else at + capacity
                    row.append(r)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(raw[4 * at : 4 * to]))
            ids = b.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return pick(df, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the order given."""
    bits, count, bins = 0, 0, 0
    at_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    which, offset = [], []
    for n in lengths:
        fitting = bits >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            bin_ = at_free[free].pop()
            if not at_free[free]:
                bits &= ~(1 << free)
            count -= 1
        else:
            if count == open_bins:
                fullest = (bits & -bits).bit_length() - 1
                at_free[fullest].pop()
                if not at_free[fullest]:
                    bits &= ~(1 << fullest)
                count -= 1
            free, bin_ = capacity, bins
            bins += 1
        which.append(bin_)
        offset.append(capacity - free)
        free -= n
        if free:
            at_free[free].append(bin_)
            bits |= 1 << free
            count += 1
    return which, offset


def pack(found: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces, which are a written table: a row's place in it deals equal rows apart."""
    ship(found.sparkSession)
    n = found.count()
    groups = max(1, -(-n // group))
    dealt = found.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def run(keys, t):
        g = keys[0].as_py()
        length = t.column("length").to_numpy()
        order = np.argsort(-length, kind="stable")
        which, offset = best_fit(length[order].tolist(), capacity, open_bins)
        t = t.drop_columns(["g"]).take(pa.array(order))
        return t.append_column("sequence_id", pa.array(np.asarray(which, np.int64) + (g << 32))).append_column("offset", pa.array(offset, pa.int64()))

    kind = found.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("g").applyInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(df: DataFrame, vocab: str) -> DataFrame:
    return pack(cut(pieces(df, vocab), "pieces"))
