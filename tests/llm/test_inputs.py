"""Defined results for awkward tables: clashing and dotted column names, ids that are null or no numbers, repeats, long texts, no rows."""

import subprocess
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

pytest.importorskip("voxelwave.llm")
P = pytest.importorskip("public_tokenizers")

from voxelwave.llm import bpe, langid, licenses, media, packing, quality, secrets, simhash, substring  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
LONG = "the quick brown fox jumps over the lazy dog and runs " * 4000
TEXTS = ["one two three four five six", None, "", "one two three four five six", LONG, LONG, "password = hunter2222 x", "Released under the MIT License."]
#: Names that operators use inside, names with dots, and names that differ by case from an input's.
CLASH = ["_score", "_lang_pred", "score", "lang_pred", "_first", "first", "_spans", "spans", "_id", "id", "_text", "a.b", "TEXT", "blob", "_blob", "fp", "component_id", "g", "c0_", "_part", "_made", "_kind", "bucket", "part", "n_words", "quality", "h"]


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")


WHOLE = {
    "bpe": lambda s, d: bpe.round_trip(d, PATH),
    "licenses": lambda s, d: licenses.scan(d),
    "media": lambda s, d: media.store_and_read(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "langid": lambda s, d: langid.identify(d),
    "packing": lambda s, d: packing.pack_documents(d, PATH),
    "secrets": lambda s, d: secrets.scan(d),
    "quality": lambda s, d: quality.score(d, quality.learn(d, labels(s))),
    "substring": lambda s, d: substring.digests(d),
}
STAGE = {
    "language": lambda s, d: langid.keep_identified(d, 0.0),
    "near": lambda s, d: simhash.keep_first(d),
    "repeats": lambda s, d: substring.remove_repeats(d),
    "redact": lambda s, d: secrets.redact(d),
}


def awkward(spark, first=0):
    kinds = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASH)
    rows = [(first + i, t, "en", *CLASH) for i, t in enumerate(TEXTS)] + [(None, "null id one two three", "en", *CLASH)] * 2 + [(first, TEXTS[0], "en", *CLASH)]
    return spark.createDataFrame(rows, kinds).repartition(3)


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_operator_on_awkward_table(spark, name):
    df = awkward(spark)
    got = WHOLE[name](spark, df).collect()
    ids = sorted(str(r.doc_id) for r in got)
    if name == "packing":  # a long text has several pieces
        got = [r for r in got if r.piece == 0]
        ids = sorted(str(r.doc_id) for r in got)
    assert ids == sorted(["0", "0", *map(str, range(1, 8)), "None", "None"])
    # equal rows, equal results, wherever they were packed
    one, two = ([v for k, v in sorted(r.asDict().items()) if k not in ("sequence_id", "offset")] for r in got if r.doc_id == 0)
    assert one == two


@pytest.mark.parametrize("name", sorted(STAGE))
def test_stage_keeps_columns(spark, name):
    df = awkward(spark)
    out = STAGE[name](spark, df)
    assert out.columns == df.columns
    got = out.collect()
    assert got and all(tuple(r)[3:] == tuple(CLASH) for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r[0], []).append(r[1])
    if name == "near":
        assert set(by_id) == {None, 0, 1, 4, 6, 7} and len(by_id[0]) == 2 and len(by_id[None]) == 2
    if name == "redact":
        assert by_id[6] == ["[SECRET] x"] and by_id[1] == [None] and by_id[4] == [LONG]
    if name == "language":
        assert 1 not in by_id and 2 not in by_id and len(by_id[None]) == 2
    if name == "repeats":
        assert by_id[4] == [LONG] and by_id[5] == [""] and by_id[1] == [None] and len(by_id[0]) == 2


@pytest.mark.parametrize("name", sorted(WHOLE) + sorted(STAGE))
def test_no_rows(spark, name):
    out = (WHOLE | STAGE)[name](spark, awkward(spark).limit(0))
    assert out.count() == 0


@pytest.mark.parametrize("name", ["bpe", "licenses", "media", "simhash", "langid", "packing", "secrets", "redact", "near"])
def test_ids_need_not_be_numbers(spark, name):
    df = spark.createDataFrame([(f"doc-{i}", t, "en") for i, t in enumerate(TEXTS)], "doc_id string, text string, lang string")
    assert {r.doc_id for r in (WHOLE | STAGE)[name](spark, df).collect()} <= {f"doc-{i}" for i in range(8)}


def test_substring_asks_for_integers(spark):
    with pytest.raises(TypeError, match="integers"):
        substring.digests(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_every_language_is_learned(spark):
    rows = [(i, " ".join(chr(0x4E00 + 40 * (i % 70) + k) * 2 for k in range(12)), f"l{i % 70:02d}", "s") for i in range(1400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    assert {r.lang_pred for r in langid.identify(df).collect()} == {f"l{k:02d}" for k in range(70)}


def test_rows_of_one_id_are_learned(spark):
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2)  # not held out
    rows = [(one, f"schon {k} gewesen nicht wahr und über {k * k}", "de", "s") for k in range(6000)] + [(k, f"the thing {k} was there with {k * k}", "en", "s") for k in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = langid.identify(df)
    wrong = got.where("doc_id IS NOT NULL").where((F.col("doc_id") == one) != (F.col("lang_pred") == "de")).count()
    assert wrong == 0


def test_fresh_session_elsewhere(tmp_path):
    """The first query of a session whose workers do not have this repository on their path."""
    root = Path(__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from voxelwave.llm import queries
print("rows", queries.op5_langid(spark, "/root/testdata/sf0.001").count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 200" in done.stdout, done.stderr[-2000:]
