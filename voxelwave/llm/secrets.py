"""Operator 8: secret scans over an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger, a table in shared storage, holds the findings of
each (blob, rule version) pair that was ever scanned. A run scans only blobs that the ledger lacks, each once however many
paths carry it, appends their findings and joins the ledger back to all paths.

Cases: a null text is an empty blob. Repeated rows and ids are paths like any others; a null id is kept. Matches and offsets
are counted in code points over the whole text. An empty table gives an empty table. Extra columns are
ignored by ``scan`` and kept by ``redact``, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelwave.llm.rows import pick, place, plain
from voxelwave.runtime import cut, exists, scratch, ship

RULE_VERSION = 1
#: The base rules, then the added ones, in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "pem")


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, ordered by start and kind. Failing assignments are consumed, then dropped."""
    out = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if "eyJ" in text:
        out += [(*m.span(), "jwt") for m in JWT.finditer(text)]
    if "-----BEGIN " in text:
        out += [(*m.span(), "pem") for m in PEM.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


FINDINGS = "blob binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(texts: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                found = spans(text)
                base = [s for s in found if s[2] in BASE]
                count = [sum(s[2] == k for s in base) for k in BASE]
                rows.append((*count, hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return texts.select("blob", "text").mapInArrow(run, FINDINGS)


class Ledger:
    """Findings by blob and rule version, in a folder that all executors share."""

    def __init__(self, spark, path: str | None = None, rule_version: int = RULE_VERSION):
        self.spark, self.version = spark, rule_version
        self.path = path or scratch(spark, "ledger")

    def findings(self) -> DataFrame | None:
        path = f"{self.path}/rule_version={self.version}"
        return self.spark.read.schema(FINDINGS).parquet(path) if exists(self.spark, path) else None

    def scan(self, df: DataFrame) -> DataFrame:
        """(id, findings) for every row. Blobs that the ledger lacks are scanned once and recorded."""
        ship(self.spark)
        texts = pick(df, "doc_id", "text").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
        paths = cut(texts.select("id", "blob"), "paths")
        blobs = paths.groupBy("blob").agg(F.min("id").alias("rep"))
        known = self.findings()
        if known is not None:
            blobs = blobs.join(known.select("blob"), "blob", "left_anti")
        unseen = blobs.select(F.col("blob").alias("_blob"), "rep").hint("shuffle_hash")
        # one text a blob is read: the one of its smallest path; text is dealt by path and blob, so copies do not meet
        fresh = texts.join(unseen, (texts.blob == F.col("_blob")) & texts.id.eqNullSafe(F.col("rep"))).select("blob", "text")
        _scan(fresh).write.mode("append").parquet(f"{self.path}/rule_version={self.version}")
        # a path given in several equal rows is scanned as often; one record is enough
        # both sides come from tables, so that a blob of very many paths can be split by the adaptive join
        return paths.join(cut(self.findings().dropDuplicates(["blob"]), "findings"), "blob")


def scan(df: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return (ledger or Ledger(df.sparkSession)).scan(df).select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def redact(df: DataFrame, mark: str = "[SECRET]", ledger: Ledger | None = None) -> DataFrame:
    """All rows and columns; spans of secrets are replaced by ``mark`` (overlapping ones by a single mark)."""
    found = (ledger or Ledger(df.sparkSession)).scan(df).where("spans <> ''").select(F.col("id").alias("_id"), F.col("blob").alias("_blob"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_blob"])
    ship(df.sparkSession)
    rows, doc, text_col = plain(df), place(df, "doc_id"), place(df, "text")
    names = rows.columns
    text_at = names.index(text_col)

    def run(batches):
        for b in batches:
            out = []
            for text, listed_spans in zip(b.column(text_at).to_pylist(), b.column(len(names)).to_pylist()):
                if listed_spans and text:
                    parts, at = [], 0
                    for s in listed_spans.split(","):
                        _, a, z = s.split(":")
                        a, z = int(a), int(z)
                        if a >= at:
                            parts += [text[at:a], mark]
                        at = max(at, z)
                    text = "".join([*parts, text[at:]])
                out.append(text)
            cols = list(b.columns[: len(names)])
            cols[text_at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    same = rows[doc].eqNullSafe(F.col("_id")) & (F.unhex(F.sha2(F.coalesce(rows[text_col], F.lit("")), 256)) == F.col("_blob"))
    return rows.join(found.hint("shuffle_hash"), same, "left").select(*names, "_spans").mapInArrow(run, rows.schema).toDF(*df.columns)
