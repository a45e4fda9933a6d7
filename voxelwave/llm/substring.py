"""Operator 10: incremental substring deduplication over a log-structured fingerprint index.

The index holds 64-bit fingerprints of windows of consecutive words in immutable runs: each run is sorted by fingerprint
within each of a fixed number of buckets and stores the owner (the document of smallest id that has the window). A new batch

1. deals its texts into parts and writes each part's distinct window fingerprints, sorted, by bucket;
2. merge-joins them, bucket by bucket, with all runs and with each other; fingerprints that are new, or now have a smaller
   owner, become one more run, and each part is told which of its fingerprints have an earlier owner;
3. marks the covered words of its texts, and states each covered passage as a claim: these words occur in that owner.

Claims are then verified against the owners' texts, word for word. A window that its owner lacks shares its fingerprint with
another one. Every document that has it made the same claim, so the first of these is its true owner, and only that document
is mended: its words are marked again without the window. No pass is repeated, however many fingerprints collide.

A call works in a fixed number of batches in the order of ids, so that what is read and shuffled grows with the table; the index
may be kept and given to later calls, which then find the passages of earlier ones. When it has more than ``max_runs`` runs
they are compacted into one. A hot passage or a large group of copies costs one fingerprint a part, not one a copy. Fingerprints
travel as sorted, delta-coded blocks. Nothing is collected to the driver but counts.

Cases: null texts have no words. Only a document with a smaller id can own a window, so rows that share an id do not cover
each other, and rows without an id neither cover nor are covered. Ids are integers; others raise a TypeError. Texts with fewer
words than a window lose nothing. Very long texts are handled in one piece by vectorised code. Repeated rows get equal results.
An empty table gives an empty table. Extra columns are ignored, or kept by ``remove_repeats``, whatever they are called. A later
call does not change the results of earlier ones, even if its ids are smaller.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxelwave.llm.arrowtext import text_view, window_hashes, word_hashes, words
from voxelwave.llm.rows import FEW, pick, place, plain
from voxelwave.runtime import cut, exists, own_shuffles, remove, scratch, ship

WINDOW = 13
SEED = 10
#: Batches of a call: what lies on disk at once shrinks with their number, what is read of the index grows with it.
BATCHES = 4
#: Text bytes of a part, and words of a bucket over the whole table, that a task should hold.
PART_BYTES = 4 << 20
BUCKET_WORDS = 1 << 19
LEAST_PARTS = 48
#: Slices of buckets that are merged one after another; what is on disk at once beside the index shrinks with them.
SLICES = 2
#: Text bytes, and buckets, that one writing task should hold; small files cost more than their bytes.
TASK_BYTES = 32 << 20
TASK_BUCKETS = 16
#: Shorter lists of fingerprints or ids are stored as they are.
SHORT = 32
#: Leading bits of fingerprints by which earlier texts are searched for the windows of failed claims.
MARK_BITS = 20

_BLOCK = "kind string, bucket int, part int, n int, fps binary, docs binary"


# ---------------------------------------------------------------- blocks of sorted fingerprints


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted uint64 as compressed byte planes of their differences."""
    if len(x) < SHORT:
        return x.tobytes()
    d = np.diff(x, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 8).T.tobytes())


def pack_ids(x: np.ndarray) -> bytes:
    """int64 ids as compressed byte planes; a short list of distinct ids is stored once."""
    if len(x) < SHORT:
        return x.tobytes()
    table, index = np.unique(x, return_inverse=True)
    zip_ = zstandard.ZstdCompressor(level=1).compress
    if 4 * len(table) <= len(x):
        head = zip_(table.tobytes())
        return len(head).to_bytes(4, "little") + head + zip_(index.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
    return b"\0\0\0\0" + zip_(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes())


def _planes(raw: bytes, n: int, width: int) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(1, n * width))
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).reshape(-1)


def unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    if n < SHORT:
        return np.frombuffer(raw, np.uint64)
    return np.cumsum(_planes(raw, n, 8).view(np.uint64), dtype=np.uint64)


def unpack_ids(raw: bytes, n: int) -> np.ndarray:
    if n < SHORT:
        return np.frombuffer(raw, np.int64)
    head = int.from_bytes(raw[:4], "little")
    if not head:
        return _planes(raw[4:], n, 8).view(np.int64)
    table = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[4 : 4 + head], max_output_size=8 * n), np.int64)
    return table[_planes(raw[4 + head :], n, 4).view(np.uint32)]


# ---------------------------------------------------------------- kernels


def fold(x: np.ndarray, bits: int) -> np.ndarray:
    """Keep the leading bits of a fingerprint only (tests make collisions that way)."""
    return x if bits == 64 else x & ~np.uint64((1 << 64 - bits) - 1)


class Windows:
    """Windows of a part's texts: fingerprints, rows and places."""

    def __init__(self, text: pa.Array, ids: np.ndarray, valid: np.ndarray, window: int, seed: int, bits: int):
        data, offsets = text_view(text)
        starts, ends, self.word_offsets = words(data, offsets)
        counts = np.diff(self.word_offsets)
        fps = window_hashes(word_hashes(data, starts, ends, seed), window, seed)
        row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)[: len(fps)]
        at = np.arange(len(fps), dtype=np.int32)
        keep = (at + window <= self.word_offsets[1:][row]) & valid[row]
        self.fps, self.row, self.at = fold(fps[keep], bits), row[keep], at[keep]
        self.doc = ids[self.row]

    def firsts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct fingerprints, the smallest id of each, and each window's place among them."""
        order = np.lexsort((self.doc, self.fps))
        f = self.fps[order]
        new = np.ones(len(f), bool)
        new[1:] = f[1:] != f[:-1]
        place = np.empty(len(f), np.int64)
        place[order] = np.cumsum(new) - 1
        return f[new], self.doc[order][new], place


def _ids(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    c = t.column(name).combine_chunks()
    return c.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), ~np.asarray(c.is_null())


def _rows(kind: list, bucket: list, part: list, n: list, fps: list, docs: list) -> pa.Table:
    return pa.table([pa.array(kind, pa.string()), pa.array(bucket, pa.int32()), pa.array(part, pa.int32()), pa.array(n, pa.int32()), pa.array(fps, pa.binary()), pa.array(docs, pa.binary())], ["kind", "bucket", "part", "n", "fps", "docs"])


def _each(t: pa.Table):
    """Rows one at a time, so that a group's blocks are not copied all at once."""
    for b in t.to_batches():
        for k in range(b.num_rows):
            yield {c: b.column(c)[k].as_py() for c in ("kind", "n", "fps", "docs")} | ({"part": b.column("part")[k].as_py()} if "part" in b.schema.names else {})


def _emit(buckets: int, window: int, seed: int, bits: int):
    def run(keys, t):
        ids, valid = _ids(t, "_id")
        w = Windows(t.column("_text"), ids, valid, window, seed, bits)
        fps, docs, _ = w.firsts()
        # a bucket is a range of fingerprints
        bounds = np.searchsorted(fps, (np.arange(buckets + 1, dtype=object) * (1 << 64) // buckets)[:-1].astype(np.uint64)).tolist() + [len(fps)]
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if a < b:
                for column, v in zip(out, ("batch", k, keys[0].as_py(), b - a, pack_sorted(fps[a:b]), pack_ids(docs[a:b]))):
                    column.append(v)
        return _rows(*out)

    return run


def _merge(keys, t):
    """One bucket: runs of the index against the parts of a batch."""
    bucket = keys[0].as_py()
    parts, runs = [], []
    for r in _each(t):
        if r["kind"] == "batch":
            parts.append((r["part"], unpack_sorted(r["fps"], r["n"]), unpack_ids(r["docs"], r["n"])))
        else:
            runs.append((unpack_sorted(r["fps"], r["n"]), unpack_ids(r["docs"], r["n"])))
    out: tuple[list, ...] = ([], [], [], [], [], [])
    if not parts:
        return _rows(*out)
    fps = np.concatenate([p[1] for p in parts])
    docs = np.concatenate([p[2] for p in parts])
    order = np.lexsort((docs, fps))
    sorted_fps = fps[order]
    new = np.ones(len(fps), bool)
    new[1:] = sorted_fps[1:] != sorted_fps[:-1]
    distinct, owner = sorted_fps[new], docs[order][new]
    # fingerprints that the index lacks, or has with a larger owner
    fresh = np.ones(len(distinct), bool)
    for run_fps, run_docs in runs:
        at = np.searchsorted(run_fps, distinct)
        hit = at < len(run_fps)
        hit[hit] = run_fps[at[hit]] == distinct[hit]
        known = run_docs[at[hit]]
        fresh[hit] &= owner[hit] < known
        owner[hit] = np.minimum(owner[hit], known)

    def add(*values) -> None:
        for column, v in zip(out, values):
            column.append(v)

    if fresh.any():
        add("run", bucket, -1, int(fresh.sum()), pack_sorted(distinct[fresh]), pack_ids(owner[fresh]))
    for part, f, d in parts:
        at = np.searchsorted(distinct, f)
        told = owner[at] < d
        if told.any():
            add("reply", bucket, part, int(told.sum()), pack_sorted(f[told]), pack_ids(owner[at[told]]))
    return _rows(*out)


def _compact(keys, t):
    rows = [*_each(t)]
    fps = np.concatenate([unpack_sorted(r["fps"], r["n"]) for r in rows])
    docs = np.concatenate([unpack_ids(r["docs"], r["n"]) for r in rows])
    order = np.lexsort((docs, fps))
    fps, docs = fps[order], docs[order]
    new = np.ones(len(fps), bool)
    new[1:] = fps[1:] != fps[:-1]
    fps, docs = fps[new], docs[new]
    return _rows(["run"], [keys[0].as_py()], [-1], [len(fps)], [pack_sorted(fps)], [pack_ids(docs)])


def _cover(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words the windows from these different starts cover."""
    edge = np.zeros(n + window + 1, np.int32)
    edge[starts] += 1
    edge[starts + window] -= 1
    return np.cumsum(edge)[:n] > 0


def _finish(window: int, seed: int, bits: int, schema: pa.Schema, text_out: bool):
    """Mark covered words; rows of documents and rows of claims share a schema."""

    def run(keys, t, replies):
        ids, valid = _ids(t, "_id")
        w = Windows(t.column("_text"), ids, valid, window, seed, bits)
        fps, first, place = w.firsts()
        owner, told = first.copy(), np.zeros(len(fps), bool)
        for r in _each(replies):
            at = np.searchsorted(fps, unpack_sorted(r["fps"], r["n"]))
            owner[at], told[at] = unpack_ids(r["docs"], r["n"]), True
        covered = told[place] | (first[place] < w.doc)
        gone = _cover(w.at[covered], w.word_offsets[-1], window)
        by = owner[place]
        hits = np.flatnonzero(covered)
        # passages: consecutive covered windows of one row with one owner
        new = np.ones(len(hits), bool)
        new[1:] = (np.diff(w.at[hits]) != 1) | (w.row[hits][1:] != w.row[hits][:-1]) | (by[hits][1:] != by[hits][:-1])
        firsts_, lasts = hits[new], hits[np.append(np.flatnonzero(new)[1:] - 1, len(hits) - 1)] if len(hits) else hits
        passages: dict[int, list[tuple[int, int, int]]] = {}
        for a, z in zip(firsts_.tolist(), np.asarray(lasts).tolist()):
            passages.setdefault(int(w.row[a]), []).append((int(by[a]), int(w.at[a]), int(w.at[z]) + window))
        n_words, n_gone, made, key, cover_ = [], [], [], [], []
        claims: dict[tuple[int, bytes], tuple[bytes, set[int]]] = {}
        offs = w.word_offsets.tolist()
        text = t.column("_text").combine_chunks()
        for r in range(t.num_rows):
            a, b = offs[r], offs[r + 1]
            raw = text[r].as_buffer().to_pybytes() if text[r].is_valid else None
            removed = int(gone[a:b].sum())
            n_words.append(b - a)
            n_gone.append(removed)
            key.append(hashlib.sha256(raw).digest() if removed else None)
            cover_.append(np.array([(x - a, z - window + 1 - a) for _, x, z in passages[r]], "<i8").tobytes() if removed else None)
            if removed:
                split = raw.split()
                for src, x, z in passages[r]:
                    claim = b" ".join(split[x - a : z - a])
                    claims.setdefault((src, hashlib.sha256(claim).digest()), (claim, set()))[1].add(int(ids[r]))
                kept = b" ".join(compress(split, (~gone[a:b]).tolist()))
            elif text_out:
                kept = raw
            else:
                kept = b" ".join(raw.split()) if raw else b""
            made.append(_made(kept, text_out))
        n, m = t.num_rows, len(claims)
        nulls = lambda f, k: pa.nulls(k, f.type)
        by_ids = [np.array(sorted(c[1]), np.int64) for c in claims.values()]
        cols = {
            "_kind": ["doc"] * n + ["claim"] * m,
            "_n_words": n_words + [len(x) for x in by_ids],
            "_n_removed": n_gone + [None] * m,
            "_made": made + [None] * m,
            "_src": [i if v else None for i, v in zip(ids.tolist(), valid.tolist())] + [k[0] for k in claims],
            "_digest": key + [k[1] for k in claims],
            "_claim": cover_ + [c[0] for c in claims.values()],
            "_docs": [None] * n + [pack_ids(x) for x in by_ids],
        }
        arrays = []
        for f in schema:
            if f.name in cols:
                arrays.append(pa.array(cols[f.name], f.type))
            else:
                arrays.append(pa.concat_arrays([*t.column(f.name).cast(f.type).chunks, nulls(f, m)]) if t.num_rows else nulls(f, m))
        return pa.Table.from_arrays(arrays, schema=schema)

    return run


def _made(kept: bytes | None, text_out: bool) -> str | None:
    """What a row's kept words come to: themselves, or their digest."""
    return None if kept is None else kept.decode() if text_out else hashlib.sha256(kept).hexdigest()


# ---------------------------------------------------------------- index


class Index:
    """Immutable runs in shared storage, one folder each; a run lies in slices of buckets that are merged one after another.

    An index that is opened again at its path finds its complete runs; its number of buckets is that with which it was made.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64, max_runs: int = 8):
        self.spark, self.buckets, self.max_runs = spark, buckets, max_runs
        self.path = path or scratch(spark, "index")
        self.runs: list[str] = []
        self.next = 0
        if path and exists(spark, f"{path}/made/_SUCCESS"):
            self.buckets = spark.read.schema("buckets int").parquet(f"{path}/made").first()[0]
        elif path:
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/made")
        while exists(spark, f"{self.path}/{self.next}"):
            here = f"{self.path}/{self.next}"
            if all(exists(spark, f"{here}/{j}/_SUCCESS") for j in range(SLICES)):
                self.runs.append(here)
            self.next += 1

    def _tasks(self) -> int:
        return max(self.spark.sparkContext.defaultParallelism, -(-self.buckets // SLICES // TASK_BUCKETS))

    def _write(self, rows: DataFrame, path: str) -> None:
        with own_shuffles(self.spark):
            rows.coalesce(self._tasks()).write.parquet(path)

    def read(self, piece: int) -> DataFrame | None:
        """Blocks of all runs in one slice."""
        if not self.runs:
            return None
        return self.spark.read.schema(_BLOCK).parquet(*(f"{r}/{piece}" for r in self.runs)).where("kind = 'run'")

    def merge(self, blobs: DataFrame) -> DataFrame:
        """Merge-join a batch's blocks with all runs, slice by slice; what is new becomes a run, the replies are given back.

        ``blobs`` is a written table with a ``slice`` column, so that only a slice's blocks are dealt at once.
        """
        here = f"{self.path}/{self.next}"
        for j in range(SLICES):
            rows = blobs.where(F.col("slice") == j).drop("slice")
            known = self.read(j)
            both = rows if known is None else rows.unionByName(known)
            self._write(both.groupBy("bucket").applyInArrow(_merge, _BLOCK), f"{here}/{j}")
        self.next += 1
        self.runs.append(here)
        return self.spark.read.schema(_BLOCK).parquet(*(f"{here}/{j}" for j in range(SLICES))).where("kind = 'reply'")

    def settle(self) -> None:
        """Too many runs become one; replies that lie beside their fingerprints go with the old ones."""
        if len(self.runs) > self.max_runs:
            self.compact()

    def compact(self) -> None:
        """All runs become one, slice by slice; the old ones go when it is written. Empty folders keep the numbering.

        A compaction that is broken off leaves the old runs, or both: an owner is the smallest that any run has.
        """
        here = f"{self.path}/{self.next}"
        for j in range(SLICES):
            self._write(self.read(j).groupBy("bucket").applyInArrow(_compact, _BLOCK), f"{here}/{j}")
        self.next += 1
        for r in self.runs:
            for j in range(SLICES):
                remove(self.spark, f"{r}/{j}")
        self.runs = [here]


# ---------------------------------------------------------------- operator


def _verify(claims: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """(src, digest, window) of claimed windows that no row of their owner has; written. ``texts`` are (_src, _text)."""
    distinct = claims.groupBy("_src", "_digest").agg(F.first("_claim").alias("_claim"))
    dealt = distinct.groupBy("_src", F.pmod(F.xxhash64("_digest"), F.lit(64)).alias("salt")).agg(F.collect_list(F.struct("_digest", "_claim")).alias("claims"))

    def run(batches):
        for b in batches:
            src, digest, lost, row = [], [], [], []
            for owner, text, claimed in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                whole = b" " + b" ".join(text.as_buffer().to_pybytes().split() if text.is_valid else []) + b" "
                for c in claimed:
                    if b" " + c["_claim"] + b" " not in whole:
                        cut_ = c["_claim"].split()
                        for i in range(len(cut_) - window + 1):
                            w = b" ".join(cut_[i : i + window])
                            if b" " + w + b" " not in whole:
                                src.append(owner)
                                digest.append(c["_digest"])
                                lost.append(w)
                                row.append(hashlib.sha256(whole).digest())
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, lost, row))], ["src", "digest", "window", "row"])

    with_claims = texts.join(dealt.hint("shuffle_hash"), "_src").select("_src", "_text", "claims")
    lost = cut(with_claims.mapInArrow(run, "src long, digest binary, window binary, row binary"), "lost")
    if lost.isEmpty():
        return lost.drop("row")
    # rows may share an id: a window is lost if each of them lacks it
    words_of = F.trim(F.regexp_replace(F.coalesce("_text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    owners = lost.select("src").distinct()
    rows = texts.join(owners, F.col("_src") == F.col("src"), "left_semi").groupBy(F.col("_src").alias("src")).agg(F.count_distinct(F.sha2(words_of, 256)).alias("rows"))
    misses = lost.groupBy("src", "digest", "window").agg(F.count_distinct("row").alias("misses"))
    return cut(misses.join(rows, "src").where("misses >= rows").select("src", "digest", "window"), "missed")


def _marked(texts: DataFrame, lost: DataFrame, window: int, seed: int) -> DataFrame:
    """(doc, window) of the windows of ``lost`` in texts of earlier calls; these are read once, windows told apart by leading bits first."""
    spark = texts.sparkSession

    def bits(batches):
        for b in batches:
            data, offsets = text_view(b.column(0).cast(pa.string()))
            starts, ends, at = words(data, offsets)
            fps = window_hashes(word_hashes(data, starts, ends, seed), window, seed)[at[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array((fps >> np.uint64(64 - MARK_BITS)).astype(np.int32))], ["bits"])

    marks = np.zeros(1 << MARK_BITS, bool)
    # at most 2**MARK_BITS rows
    marks[[r.bits for r in lost.select("window").distinct().mapInArrow(bits, "bits int").distinct().collect()]] = True
    shared = spark.sparkContext.broadcast(marks)

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            w = Windows(b.column(1), ids, np.ones(len(ids), bool), window, seed, 64)
            hits = np.flatnonzero(shared.value[(w.fps >> np.uint64(64 - MARK_BITS)).astype(np.int64)])
            split: dict[int, list[bytes]] = {}
            doc, found = [], []
            for r, at in zip(w.row[hits].tolist(), w.at[hits].tolist()):
                if r not in split:
                    split = {r: b.column(1)[r].as_buffer().to_pybytes().split()}
                k = at - int(w.word_offsets[r])
                doc.append(int(ids[r]))
                found.append(b" ".join(split[r][k : k + window]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(found, pa.binary())], ["doc", "window"])

    return texts.where("_src IS NOT NULL AND _text IS NOT NULL").select("_src", "_text").mapInArrow(run, "doc long, window binary")


def _mend(found: DataFrame, lost: DataFrame, df: DataFrame, earlier: DataFrame | None, window: int, seed: int, text_out: bool) -> DataFrame:
    """Rows of ``found`` after failed claims: the first document of a window that its owner lacks is marked again without it."""
    claims = found.where("_kind = 'claim'").select(F.col("_src").alias("src"), F.col("_digest").alias("digest"), F.col("_n_words").cast("int").alias("n"), "_docs")

    def unpack(batches):
        for b in batches:
            ids = [unpack_ids(raw, n) for raw, n in zip(b.column(1).to_pylist(), b.column(0).to_pylist())]
            at = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)), b.column(2).take(pa.array(at))], ["doc", "window"])

    have = claims.join(lost, ["src", "digest"]).select("n", "_docs", "window").mapInArrow(unpack, "doc long, window binary")
    if earlier is not None:
        have = have.unionByName(_marked(earlier, lost, window, seed).join(lost.select("window").distinct(), "window", "left_semi").select("doc", "window"))
    first = have.groupBy("window").agg(F.min("doc").alias("doc"))
    wrong = cut(first.groupBy("doc").agg(F.collect_list("window").alias("windows")), "wrong")
    wrong = F.broadcast(wrong) if wrong.count() <= FEW else wrong
    docs = found.where("_kind = 'doc'")
    same = df.join(wrong.select(F.col("doc").alias("_src")), F.col("_id") == F.col("_src"), "left_semi")
    texts = same.select(F.col("_id").cast("long").alias("_src"), F.unhex(F.sha2(F.col("_text"), 256)).alias("_digest"), "_text").dropDuplicates(["_src", "_digest"])
    marked = docs.where("_digest IS NOT NULL").join(wrong.withColumnRenamed("doc", "_src"), "_src").join(texts, ["_src", "_digest"]).select(*found.columns, "_text", "windows")
    names = found.columns

    def run(batches):
        for b in batches:
            made, gone_ = [], []
            at = {n: b.column(n) for n in ("_claim", "_text", "windows")}
            for r in range(b.num_rows):
                split = at["_text"][r].as_buffer().to_pybytes().split()
                bad = set(at["windows"][r].as_py())
                runs = np.frombuffer(at["_claim"][r].as_py(), "<i8").reshape(-1, 2)
                starts = [k for x, z in runs.tolist() for k in range(x, z) if b" ".join(split[k : k + window]) not in bad]
                gone = _cover(np.array(starts, np.int64), len(split), window)
                kept = b" ".join(compress(split, (~gone).tolist()))
                # a text that loses nothing stays as it is
                made.append(at["_text"][r].as_py() if text_out and not starts else _made(kept, text_out))
                gone_.append(int(gone.sum()))
            cols = {"_made": pa.array(made, pa.string()), "_n_removed": pa.array(gone_, pa.int64())}
            yield pa.RecordBatch.from_arrays([cols.get(n, b.column(n)) for n in names], names)

    marked = marked.mapInArrow(run, found.schema)
    whole = docs.join(wrong.select(F.col("doc").alias("d")), (F.col("_src") == F.col("d")) & F.col("_digest").isNotNull(), "left_anti")
    return whole.unionByName(marked)


def _pass(df: DataFrame, index: Index, edges: list[int], parts: int, window: int, seed: int, bits: int, schema: T.StructType, text_out: bool, out: str, part_bytes: int) -> None:
    """All batches: results and claims go to ``out``."""
    spark = df.sparkSession
    arrow = to_arrow_schema(schema)
    bounds = [None, *edges, None]
    tasks = max(spark.sparkContext.defaultParallelism, -(-parts * part_bytes // TASK_BYTES))
    for lo, hi in zip(bounds, bounds[1:]):
        batch = df
        if lo is not None:
            batch = batch.where(F.col("_id") > lo)
        if hi is not None:
            # rows without an id go with the first batch
            batch = batch.where((F.col("_id") <= hi) | F.col("_id").isNull()) if lo is None else batch.where(F.col("_id") <= hi)
        batch = batch.withColumn("_part", F.pmod(F.xxhash64("_id", "_text"), F.lit(parts)).cast("int"))
        blocks = batch.select("_id", "_text", "_part").groupBy("_part").applyInArrow(_emit(index.buckets, window, seed, bits), _BLOCK)
        path = scratch(spark, "blocks")
        with own_shuffles(spark):
            blocks.withColumn("slice", F.col("bucket") % SLICES).coalesce(tasks).write.partitionBy("slice").parquet(f"{path}/t")
        replies = index.merge(spark.read.schema(f"{_BLOCK}, slice int").parquet(f"{path}/t")).withColumnRenamed("part", "_part")
        remove(spark, path)
        done = batch.groupBy("_part").cogroup(replies.groupBy("_part")).applyInArrow(_finish(window, seed, bits, arrow, text_out), schema)
        with own_shuffles(spark):
            done.coalesce(tasks).write.mode("append").parquet(f"{out}/t")
        index.settle()


def _dedup(df: DataFrame, others: list[str], text_out: bool, window: int, batches: int, bits: int, seed: int, index: Index | None, earlier: DataFrame | None, part_bytes: int, bucket_words: int) -> DataFrame:
    """(_id, _text, others) to rows of others with _n_words, _n_removed and _made."""
    spark = df.sparkSession
    ship(spark)
    if not isinstance(df.schema["_id"].dataType, T.IntegralType):
        raise TypeError(f"ids must be integers, not {df.schema['_id'].dataType.simpleString()}")
    size = df.agg(F.sum(F.octet_length("_text")), F.min("_id"), F.max("_id")).first()
    total, low, high = size[0] or 0, size[1], size[2]
    edges = sorted({int(q) for q in df.approxQuantile("_id", [k / batches for k in range(1, batches)], 0.001)} - {high}) if low is not None and batches > 1 else []
    parts = max(LEAST_PARTS, -(-total // (len(edges) + 1) // part_bytes))
    own = index is None
    index = index or Index(spark, buckets=max(64, total // 6 // bucket_words))
    out = scratch(spark, "substring")
    made = "_kind string, _n_words long, _n_removed long, _made string, _src long, _digest binary, _claim binary, _docs binary"
    schema = T.StructType([*(df.schema[c] for c in others), *T.StructType.fromDDL(made).fields])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    _pass(df, index, edges, parts, window, seed, bits, schema, text_out, out, part_bytes)
    if own:
        remove(spark, index.path)
    found = spark.read.schema(schema).parquet(f"{out}/t")
    texts = df.select(F.col("_id").cast("long").alias("_src"), "_text")
    before = None if earlier is None else pick(earlier, "doc_id", "text").select(F.col("doc_id").cast("long").alias("_src"), F.col("text").alias("_text"))
    lost = _verify(found.where("_kind = 'claim'").select("_src", "_digest", "_claim"), texts if before is None else texts.unionByName(before), window)
    if lost.isEmpty():
        return found.where("_kind = 'doc'")
    return _mend(found, lost, df, before, window, seed, text_out)


def digests(df: DataFrame, window: int = WINDOW, batches: int = BATCHES, bits: int = 64, seed: int = SEED, index: Index | None = None, earlier: DataFrame | None = None, part_bytes: int = PART_BYTES, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256.

    A given ``index`` holds the windows of earlier calls and takes those of this one; ``earlier`` are then the documents of
    earlier calls, against which claims are verified (without them such claims are believed). Parts and buckets may be larger
    where tasks have more memory.
    """
    d = pick(df, "doc_id", "text").select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("doc_id").alias("_doc"))
    out = _dedup(d, ["_doc"], False, window, batches, bits, seed, index, earlier, part_bytes, bucket_words)
    return out.select(F.col("_doc").alias("doc_id"), F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.coalesce("_made", F.sha2(F.lit(""), 256)).alias("kept_sha256"))


def remove_repeats(df: DataFrame, window: int = WINDOW, batches: int = BATCHES, bits: int = 64, seed: int = SEED, index: Index | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """All rows and columns; texts that lose words are their kept words, joined by one space, others stay as they are."""
    rows, doc, text = plain(df), place(df, "doc_id"), place(df, "text")
    others = [c for c in rows.columns if c != text]
    d = rows.select(F.col(doc).alias("_id"), F.col(text).alias("_text"), *others)
    out = _dedup(d, others, True, window, batches, bits, seed, index, earlier, PART_BYTES, BUCKET_WORDS)
    return out.select(*(F.col("_made" if c == text else c) for c in rows.columns)).toDF(*df.columns)
