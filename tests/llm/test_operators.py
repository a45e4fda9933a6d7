"""Each operator against a brute-force version, on texts with nulls, blanks, repeats, ties and very long words."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

pytest.importorskip("voxelwave.llm")
P = pytest.importorskip("public_tokenizers")

from voxelwave.llm import bpe, components, langid, licenses, media, packing, quality, secrets, simhash, substring, topk  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = P.path("byte_bpe_50k.json")
EDGES = ["", None, " ", "\n\t ", "a", "A b\xa0c", "<|endoftext|> x", "é" * 3000, "x" * 50_000, "日本 語 1²½ 'll", "\x1c \x85", "In In In In " * 40]


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    passage = " ".join(rng.choice(vocab) for _ in range(30))
    texts = []
    for k in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if k % 3 == 0:
            words.insert(len(words) // 2, passage)
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    texts += [texts[3]] * 4 + [texts[3] + " extra", texts[4].upper()]
    return texts


def frame(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", 1, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string").repartition(3)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# ---------------------------------------------------------------- 1


@pytest.fixture(scope="module")
def library():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def fuzz():
    rng = random.Random(1)
    parts = ["a" * 50, "  ", "\n\n \n", "\x85", "\xa0", "it's 'S 'll", "<|endoftext|>", "1²½", "日本語", "👍🏽", "\0\0", "=====", "Ⅷ", "_x_", "ſ", "՘", "\U0001e5f0", "th" * 9]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(800)] + ["".join(rng.choice("abcht in'\n ") for _ in range(rng.randint(0, 60))) for _ in range(800)]


@pytest.mark.parametrize("encoder", [bpe.encode_to_bytes, bpe.library_ids])
def test_ids_are_the_librarys(library, encoder):
    texts = fuzz() + [t or "" for t in EDGES]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder(PATH, texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_round_trip(spark, library):
    df = frame(spark, EDGES)
    want = []
    for i, t in enumerate(EDGES):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows(bpe.round_trip(df, PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = bpe.decode(bpe.encode(df, PATH), PATH)
    assert {r.id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(EDGES)}
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


# ---------------------------------------------------------------- 2


def test_licenses(spark):
    texts = ["a\nReleased under the MIT License.\nb", "x " * 5000 + "Licensed under the Apache License, Version 2.0. " + "y " * 5000, "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 4.", "my driving license expired", "İ All rights reserved.", None, ""]
    got = {r.doc_id: r.licenses for r in licenses.scan(frame(spark, texts)).collect()}
    assert got == {0: "MIT", 1: "Apache-2.0", 2: "GPL-3.0", 3: "", 4: "", 5: "All-rights-reserved", 6: "", 7: ""}
    (f,) = licenses.findings(texts[0])
    assert texts[0][f.start : f.end] == "Released under the MIT License." and f.missing == () and f.saved > 0


def test_licenses_against_all_places():
    """All blocks by all templates: every wording around every place of its anchor, and the savings of every template for every block."""
    rng = random.Random(9)
    filler = ["code", "by", "all", "public", "free", "version", "2.0", "mit", "commit", "file", "the", "of", "gnu", "reserved"]
    scanner = licenses._scanner(tuple(licenses.TEMPLATES.items()))
    total = 0
    for _ in range(60):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 60))]
        for name in rng.sample(sorted(licenses.TEMPLATES), rng.randint(0, 2)):
            notice = licenses.TEMPLATES[name][0].split()
            for _ in range(rng.randint(0, 3)):
                notice.insert(rng.randint(0, len(notice)), rng.choice(filler))
            if rng.random() < 0.3:
                del notice[rng.randrange(len(notice))]
            at = rng.randint(0, len(words))
            words[at:at] = notice
        text = "".join(w + rng.choice([" ", " ", "\n", "  "]) for w in words)
        low = licenses.lowered(text)
        have, spans = licenses._placed(low)
        blocks = scanner.blocks(low)
        want, got = set(), set()
        for name, (wording, deciding) in licenses.TEMPLATES.items():
            wording = licenses.word_list(wording)
            reach = len(wording) * 3 // 2
            for i in [i for i, w in enumerate(have) if w == deciding[0]]:
                if licenses._confirm(wording, deciding, have[max(0, i - reach) : i + reach + 1]):
                    ((a, z),) = [(a, z) for a, z in blocks if a <= spans[i][0] < z]
                    raw = text[a:z].encode()
                    saved = len(scanner.plain.compress(raw)) - len(scanner.tools[name][0].compress(raw))
                    if saved >= licenses.LEAST_SAVED:
                        want.add((name, saved, a))
        for a, z in blocks:
            got |= {(name, saved, a) for name, saved, *_ in scanner._judge(text[a:z])}
        assert got == want, text
        found = licenses.findings(text)
        assert {f.license for f in found} <= {w[0] for w in want} and bool(found) == bool(want)
        total += len(want)
        if found:
            assert max(f.saved for f in found) == max(w[1] for w in want)
    assert total > 40


def test_licenses_rank_by_bytes_saved():
    text = "x y z\n" + licenses.TEMPLATES["GPL-3.0"][0] + "\nq"
    plain = licenses.zstandard.ZstdCompressor(level=3)
    scanner = licenses._scanner(tuple(licenses.TEMPLATES.items()))
    ((a, z),) = scanner.blocks(licenses.lowered(text))
    saved = {n: len(plain.compress(text[a:z].encode())) - len(c.compress(text[a:z].encode())) for n, (c, _, _) in scanner.tools.items() if n in licenses.TEMPLATES}
    (f,) = licenses.findings(text)
    assert f.license == "GPL-3.0" and f.saved == saved["GPL-3.0"] == max(saved.values())


def test_licenses_on_long_lines_and_full_texts(spark, tmp_path):
    notice = licenses.TEMPLATES["Apache-2.0-header"][0].split()
    spread = " ".join(w if i % 6 else w + " of" for i, w in enumerate(notice))
    for text in (spread, "word " * 3000 + spread + " word" * 3000):
        assert "Apache-2.0-header" in {f.license for f in licenses.findings(text)}
    mit = licenses.TEMPLATES["MIT-license"][0]
    assert [f.license for f in licenses.findings("// " + mit.replace(". ", ".\n// "))] == ["MIT-license"]
    assert len([f for f in licenses.findings("Released under the MIT License.\n" + "code " * 80 + "\nReleased under the MIT License.") if f.license == "MIT"]) == 2
    (tmp_path / "OWN-1").write_text("This software may be used on Tuesdays by gardeners, provided that flowers are watered beforehand.")
    (tmp_path / "OWN-2").write_text("This software may be used on Sundays by plumbers, provided that pipes are inspected beforehand.")
    own = licenses.read_templates(spark, str(tmp_path))
    df = frame(spark, ["a\nThis software may be used on Sundays by plumbers, provided that pipes\nare inspected beforehand.\n", "nothing"])
    assert {r.doc_id: r.licenses for r in licenses.scan(df, own).collect()} == {0: "OWN-2", 1: ""}


# ---------------------------------------------------------------- 3


def test_media_round_trip(spark):
    got = {r.doc_id: r for r in media.store_and_read(frame(spark, EDGES)).collect()}
    for i, t in enumerate(EDGES):
        raw = (t or "").encode()
        pad = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
        stored = media.pack(pad)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_media_columns_and_broken_files(spark):
    whole = media.pack(bytes(576 * 30))
    files = [whole, whole[:100], whole[:700], b"", None, b"junk" * 10, whole[:32] + b"\xff" * 4 + whole[36:]]
    df = spark.createDataFrame([(i, None if f is None else bytearray(f)) for i, f in enumerate(files)], "k int, f binary")
    got = {r.id: r for r in media.media_columns(df, "k", "f").collect()}
    assert got[0].codec == "raw " and got[0].n_samples == 30 and got[0].duration_s == 1.2 and len(got[0].keyframes) == 3 and got[0].error is None
    assert all(got[i].error for i in range(1, 7))
    ranges = [whole[k.start : k.start + k.size] for k in got[0].keyframes]
    assert all(len(r) == 576 for r in ranges)


def test_media_fragments():
    payload = bytes(random.Random(2).randrange(256) for _ in range(576 * 30))
    plain, cut = media.pack(payload), media.pack(payload, fragmented=True)
    assert media.sample_bytes(cut) == payload and cut != plain
    a, b = media.describe(plain), media.describe(cut)
    assert (a["codec"], a["duration_s"], a["n_samples"]) == (b["codec"], b["duration_s"], b["n_samples"]) == ("raw ", 1.2, 30)
    assert [cut[x : x + n] for x, n in b["keyframes"]] == [plain[x : x + n] for x, n in a["keyframes"]] and len(b["keyframes"]) == 3


@pytest.mark.parametrize("fragmented", [False, True])
def test_media_broken_anywhere(fragmented):
    """No byte of a header, wherever it is changed or cut, makes anything but a result or a MediaError."""
    rng = random.Random(4)
    whole = media.pack(bytes(576 * 25), fragmented=fragmented)
    at = whole.index(b"mdhd")
    empty = whole[: at - 4] + b"\0\0\0\x08" + whole[at:]
    files = [empty, *(whole[:k] for k in range(0, 800, 7))]
    for _ in range(1500):
        k = rng.randrange(min(len(whole), 760))
        files.append(whole[:k] + bytes([rng.randrange(256)]) + whole[k + 1 :])
    for f in files:
        try:
            media.describe(f)
        except media.MediaError:
            pass


def test_media_feature_by_an_independent_reader(spark):
    """Codec, duration, samples and keyframes found by searching the stored bytes for their boxes' names."""
    texts = ["a" * (576 * 25 + 3), "b"]
    got = {r.doc_id: r.feature for r in media.store_and_read(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = t.encode() + b"\xff" * (-len(t) % 576)
        stored = media.pack(raw)
        number = lambda name, skip: int.from_bytes(stored[stored.index(name) + skip : stored.index(name) + skip + 4], "big")
        n, size, first = number(b"stsz", 12), number(b"stsz", 8), number(b"stco", 12)
        keys = [number(b"stss", 12 + 4 * k) for k in range(number(b"stss", 8))]
        assert stored[first : first + n * size] == raw and keys == [*range(1, n + 1, 12)]
        spans = [f"{first + (k - 1) * size}+{size}" for k in keys]
        digest = hashlib.sha256(",".join(spans).encode()).hexdigest()[:16]
        codec = stored[stored.index(b"stsd") + 16 : stored.index(b"stsd") + 20].decode().strip()
        assert got[i] == f"{codec};{number(b'mdhd', 20) / number(b'mdhd', 16):.2f}s;{n};{len(keys)};{spans[0]};{spans[-1]};{digest}"


# ---------------------------------------------------------------- 4


def brute_fingerprint(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = WORD.findall(t)
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)) <= radius
    label = np.array(ids)
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label.tolist()
        label = new


def test_simhash(spark):
    texts = corpus() + EDGES
    fps = [brute_fingerprint(t) for t in texts]
    want = [(i, f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, brute_components(range(len(texts)), fps)))]
    assert rows(simhash.near_duplicates(frame(spark, texts)), "doc_id", "fingerprint", "component_id") == want
    kept = {r.doc_id for r in simhash.keep_first(frame(spark, texts)).collect()}
    assert kept == {i for i, _, c in want if i == c}
    assert simhash.near_duplicates(frame(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("tile,block", [(1 << 16, 1 << 12), (40, 16)])
def test_simhash_links_lose_nothing(spark, monkeypatch, tile, block):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.int64)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centres for _ in range(12)} | {0, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    got = {r.node: r.root for r in components.components(simhash.links(df)).collect()}
    label = brute_components(list(range(len(fps))), fps)
    groups = {}
    for f, c in zip(signed, label):
        groups.setdefault(c, set()).add(f)
    want = {f: min(g) for g in groups.values() if len(g) > 1 for f in g}
    assert got == want


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2000 + k) for k in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in nodes}


# ---------------------------------------------------------------- 5


def spoken(n=400, seed=1):
    rng = random.Random(seed)
    syllables = {"en": ["th", "ing", "ed", "ou", "sh", "er"], "de": ["ein", "sch", "ü", "ung", "ver", "ich"], "fr": ["eau", "é", "oi", "ment", "ou", "que"]}
    out = []
    for i in range(n):
        lang = rng.choice(sorted(syllables))
        out.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))), lang, "s", 1))
    return out


def test_langid(spark):
    data = spoken() + [(900, None, "en", "s", 1), (901, "123 !?", "fr", "s", 1), (902, "", None, "s", 1), (None, "thing", "en", "s", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    lang = {d[0]: d[2] for d in data}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in range(400))
    assert np.mean([got[i].lang_pred == lang[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    kept = {r.doc_id for r in langid.keep_identified(df).collect()}
    assert not kept & {900, 901, 902} and len(kept) > 390
    assert {r.lang_pred for r in langid.identify(df.where("lang is null")).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_langid_statistics_cover_all_rows(spark):
    texts = ["ab", "abc", "", "b" * 1000, "ab"]
    df, n = langid.document_frequencies(frame(spark, texts))
    want = np.zeros(langid.FEATURES, int)
    for t in texts:
        grams, _ = langid.hashed([t])
        f = np.unique(grams)
        want[f[f < langid.FEATURES]] += 1
    assert n == 5 and (df == want).all()


# ---------------------------------------------------------------- 6


def test_packing(spark, library):
    texts = corpus(40) + EDGES + ["word " * 5000]
    got = packing.pack_documents(frame(spark, texts), PATH).toPandas()
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    for i, g in got.groupby("doc_id"):
        at = 0
        for r in g.sort_values("piece").itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i]) and (g.sort_values("piece").length[1:] == 2048).all()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum().shift(fill_value=0)).all() and g.length.sum() <= 2048
    assert got.doc_id.nunique() == len(texts)
    assert got.sequence_id.nunique() <= -(-int(got.length.sum()) // 2048) + 1
    assert packing.pack_documents(frame(spark, texts).limit(0), PATH).count() == 0


def test_best_fit_is_bounded_and_valid():
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(2000)]
    for order in (lengths, sorted(lengths, reverse=True)):
        for k in (1, 7, 1000):
            which, offset = packing.best_fit(order, 100, k)
            ends = {}
            last_use, first_use = {}, {}
            for j, (w, o, n) in enumerate(zip(which, offset, order)):
                assert o == ends.get(w, 0)
                ends[w] = o + n
                assert ends[w] <= 100
                first_use.setdefault(w, j)
                last_use[w] = j
    assert len(set(packing.best_fit([60, 50, 40, 50], 100, 10)[0])) == 2
    # one open bin: the first closes when the second piece does not fit
    assert packing.best_fit([60, 50, 40], 100, 1)[0] == [0, 1, 1]


# ---------------------------------------------------------------- 7


def test_topk(spark):
    rng = np.random.default_rng(4)
    x = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(300)]
    x += [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1004, []), (1005, [1.0, 2.0]), (7, x[7][1]), (1100, x[20][1])]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    v = topk.integer_vectors(df)
    got = rows(topk.search(v, v.where("id % 20 = 0"), 20, block=64, query_block=5, few=0), "query_id", "rank", "vec_id", "score")
    clean = [(i, np.floor(64 * np.array(e))) for i, e in x if e and len(e) == 6 and all(c is not None and np.isfinite(c) for c in e)]
    want = []
    for q in sorted({i for i, _ in clean if i % 20 == 0}):
        qv = next(e for i, e in clean if i == q)
        best = sorted((-int(qv @ e), i) for i, e in clean if i != q)[:20]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    few = v.where("id in (0, 1, 2)")
    assert topk.search(few, few.where("id = 0"), 20).count() == 2
    assert topk.search(v.limit(0), v.limit(0), 20).count() == 0


@pytest.mark.parametrize("clustered", [False, True])
def test_cover_tree_invariants(clustered):
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(1500, 5)) * 20)
    if clustered:
        x = np.floor(rng.normal(size=(12, 5)) * 500)[rng.integers(0, 12, 1500)] + np.floor(rng.normal(size=(1500, 5)) * 3)
        x[100:180] = x[99]
    level, parent, top = topk.cover_levels(x, 8)
    dist = lambda a, b: np.sqrt(((x[a][:, None] - x[b]) ** 2).sum(-1))
    last = level.max()
    for i in range(1, last + 1):
        centres, new = np.flatnonzero(level <= i), np.flatnonzero(level == i)
        if i < last:  # separation; points of the last level need none
            d = dist(centres, centres)
            assert (d[np.triu_indices(len(d), 1)] > top / 2**i).all()
        # covering by a centre of the level above; nesting holds as a point stays a centre from its level on
        assert (level[parent[new]] < i).all()
        assert (np.sqrt(((x[new] - x[parent[new]]) ** 2).sum(1)) <= top / 2 ** (i - 1) + 1e-9).all()
    t = topk.CoverTree(x, leaf=16)
    ordered = x[t.order]
    for (c, a, b, first, n), r in zip(t.nodes.tolist(), t.radius):
        assert (np.sqrt(((ordered[a:b] - ordered[c]) ** 2).sum(1)) <= r + 1e-9).all()
        kids = t.nodes[first : first + n, 1:3].tolist()
        assert not n or [a, *[z for _, z in kids]] == [*[y for y, _ in kids], b]
        assert n or b - a <= 16
    assert sorted(t.order.tolist()) == list(range(1500))


def test_topk_large_values_are_exact(spark):
    big = 1 << 30
    x = [(i, [float(big + 7 * i), float(big - i), float(-big + i * i)]) for i in range(50)] + [(60, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(x, "id long, vec array<double>")
    got = rows(topk.search(v, v.where("id % 20 = 0"), 3), "query_id", "rank", "vec_id", "score")
    ints = {i: [int(c) for c in e] for i, e in x}
    want = []
    for q in (0, 20, 40, 60):
        best = sorted((-sum(a * b for a, b in zip(ints[q], e)), i) for i, e in ints.items() if i != q)[:3]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    huge = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40])], "id long, vec array<double>")
    with pytest.raises(ValueError, match="64-bit"):
        topk.search(huge, huge, 3).count()


def test_topk_blocks_are_pruned(spark):
    rng = np.random.default_rng(2)
    centres = np.floor(rng.normal(size=(8, 16)) * 3000)
    data = [(i, [float(c) for c in centres[i % 8] + np.floor(rng.normal(size=16) * 4)]) for i in range(800)] + [(i, [5.0] * 16) for i in range(1000, 1040)]
    v = spark.createDataFrame(data, "id long, vec array<double>").repartition(4)
    got = rows(topk.search(v, v.where("id % 20 = 0"), 5, block=50, query_block=10, leaf=8, roots=3, few=0), "query_id", "rank", "vec_id", "score")
    ids, m = np.array([i for i, _ in data]), np.array([e for _, e in data])
    want = []
    for q in ids[ids % 20 == 0].tolist():
        s = m @ m[ids.tolist().index(q)]
        best = sorted((-int(a), i) for a, i in zip(s, ids.tolist()) if i != q)[:5]
        want += [(q, r, i, -a) for r, (a, i) in enumerate(best, 1)]
    assert got == sorted(want)


# ---------------------------------------------------------------- 8


def brute_secrets(t):
    t = t or ""
    key = "(" + "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


SECRETS = ['x password = "hunter2222" y', "TOKEN:abc", "secret=token: abcdefgh", "api_key='A/b+c=d.e' and apikey=zzzzzz", "AKIA" + "A1" * 9, "AKIAAKIA" + "Z" * 15, "é " + "0a" * 20 + " ſecret=abcdefgh", "paKssword=abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "toKen = eyJabcdefgh1.eyJabcdefgh2.abcdefgh3", "f" * 23 + " " + "f" * 24]


def test_secrets(spark):
    texts = SECRETS + EDGES + SECRETS[:3]
    got = {r.doc_id: r for r in secrets.scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = brute_secrets(t)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(b[2] == k for b in base) for k in ("assign", "access", "hex")]
        listed = ",".join(f"{k}:{a}:{z}" for a, _, k, z in base)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(got[i].spans.split(","))
    assert "pem:" in got[8].spans and "jwt:" in got[9].spans
    assert secrets.scan(frame(spark, texts).limit(0)).count() == 0


def test_ledger_scans_only_unseen_blobs(spark):
    ledger = secrets.Ledger(spark)
    ledger.scan(frame(spark, SECRETS + SECRETS)).count()
    assert ledger.findings().count() == len(SECRETS)
    assert ledger.scan(frame(spark, SECRETS + ["new password=abcdefgh"], 500)).count() == len(SECRETS) + 1
    assert ledger.findings().count() == len(SECRETS) + 1
    other = secrets.Ledger(spark, ledger.path, rule_version=2)
    assert other.findings() is None


def test_redact(spark):
    df = frame(spark, SECRETS + EDGES)
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert secrets.redact(df).columns == df.columns
    assert got[0] == 'x [SECRET]" y' and got[1] == "TOKEN:abc" and got[10] == "f" * 23 + " [SECRET]"
    assert [got[len(SECRETS) + i] for i in range(len(EDGES))] == EDGES


# ---------------------------------------------------------------- 9


def test_quality(spark):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(10, 60))]
        docs.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good), 0))
    docs += [(700, None), (701, ""), (None, "abc")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(d, quality.learn(d, lab)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in range(600) if got[i].held_out} == set(held)
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and len(got) == 603
    none = quality.learn(d, lab.limit(0))
    assert {r.score for r in quality.score(d, none).collect()} == {0.5}


def test_quality_pairs_matter():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 2))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95


# ---------------------------------------------------------------- 10


def brute_substring(texts, window=13):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in texts]
    for i, w in sorted(split, key=lambda s: s[0]):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("batches,bits", [(1, 64), (4, 64), (3, 9)])
def test_substring(spark, batches, bits):
    texts = list(enumerate(corpus() + EDGES)) + [(3, corpus()[3]), (3, corpus()[6])]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n_words long").repartition(3)
    want = [(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute_substring(texts)]
    assert rows(substring.digests(df, batches=batches, bits=bits), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want)


@pytest.mark.parametrize("bits", [64, 9])
@pytest.mark.parametrize("later", ["larger", "smaller", "mixed"])
def test_substring_calls_share_an_index(spark, tmp_path, bits, later):
    texts = list(enumerate(corpus()))
    one = {"larger": lambda i: i < 40, "smaller": lambda i: i >= 40, "mixed": lambda i: i % 2 == 0}[later]
    calls = [[t for t in texts if one(t[0])], [t for t in texts if not one(t[0])]]
    path = "file://" + str(tmp_path / "index")
    frames = [spark.createDataFrame(c, "doc_id long, text string") for c in calls]
    want = {r[0]: r for r in brute_substring(texts)}
    first = {r[0]: r for r in brute_substring(calls[0])}
    for k, call in enumerate(calls):
        out = substring.digests(frames[k], batches=2, bits=bits, index=substring.Index(spark, path, buckets=4, max_runs=2), earlier=frames[0] if k else None)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()}
        # the second call knows all documents, the first one its own
        expect = want if k else first
        assert got == {i: (expect[i][1], expect[i][2], hashlib.sha256(expect[i][3].encode()).hexdigest()) for i, _ in call}
    assert len(substring.Index(spark, path).runs) <= 2 and substring.Index(spark, path).buckets == 4


def test_substring_mends_collisions_in_texts(spark):
    texts = corpus()
    got = {r.doc_id: r.text for r in substring.remove_repeats(frame(spark, texts), bits=9).collect()}
    for i, _, g, kept in brute_substring(list(enumerate(texts))):
        assert got[i] == (kept if g else texts[i])


def test_substring_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a " * 40), (None, "a " * 40), (1, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.digests(df).collect()) == [(0, 40, 0), (0, 40, 0), (1, 0, 0)]
    assert substring.digests(df.limit(0)).count() == 0


def test_substring_keeps_columns(spark):
    texts = corpus()
    df = frame(spark, texts)
    got = {r.doc_id: r for r in substring.remove_repeats(df).collect()}
    assert substring.remove_repeats(df).columns == df.columns and got[0].source == "s" and got[0].fingerprint == "clash"
    for i, _, g, kept in brute_substring(list(enumerate(texts))):
        assert got[i].text == (kept if g else texts[i])


def test_index_compacts(spark):
    index = substring.Index(spark, buckets=4, max_runs=2)
    seen = set()
    for k in range(4):
        fps = np.array(sorted({(k << 40) + j * (1 << 58) + k for j in range(50)}), np.uint64)
        seen |= set(fps.tolist())
        r = [("batch", int(b), 0, 1, bytearray(substring.pack_sorted(np.array([f], np.uint64))), bytearray(substring.pack_ids(np.array([k], np.int64))), int(b) % substring.SLICES) for f, b in zip(fps, (fps >> np.uint64(62)).astype(int))]
        replies = index.merge(spark.createDataFrame(r, substring._BLOCK + ", slice int"))
        assert replies.count() == 0
        index.settle()
    assert len(index.runs) <= 2
    back = set()
    for r in [r for j in range(substring.SLICES) for r in index.read(j).collect()]:
        back |= set(substring.unpack_sorted(r.fps, r.n).tolist())
    assert back == seen
    assert substring.Index(spark, index.path, 4).runs == index.runs


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    x = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    assert (substring.unpack_sorted(substring.pack_sorted(x), 1000) == x).all()
    for ids in (rng.integers(0, 5, 1000), rng.integers(-(1 << 60), 1 << 60, 1000), np.zeros(1, np.int64)):
        assert (substring.unpack_ids(substring.pack_ids(ids.astype(np.int64)), len(ids)) == ids).all()


# ---------------------------------------------------------------- queries


def test_pipeline_against_brute_force(spark, tmp_path, library):
    pipeline = pytest.importorskip("corpus_pipeline")
    data = spoken(150) + [(900, "!!! 123", "en", "s", 1), (901, None, "en", "s", 1)]
    copies = [(200 + k, data[5][1], data[5][2], "s", 1) for k in range(4)] + [(210, data[9][1] + " token = abcdefghij", data[9][2], "s", 1)]
    passage = " ".join(f"wa{k}th" for k in range(30))
    copies += [(220 + k, f"{data[20 + k][1]} {passage}", data[20 + k][2], "s", 1) for k in range(3)]
    df = pd.DataFrame(data + copies, columns=["doc_id", "text", "lang", "source", "n_chars"])
    df.to_parquet(tmp_path / "documents.parquet", index=False)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id: r.text for r in langid.keep_identified(docs).collect()}
    assert 900 not in kept and 901 not in kept
    ids = sorted(kept)
    comp = brute_components(ids, [brute_fingerprint(kept[i]) for i in ids])
    kept = {i: kept[i] for i, c in zip(ids, comp) if i == c}
    kept = {i: k if g else kept[i] for i, _, g, k in brute_substring(kept.items())}

    def redact(t):
        out, at = [], 0
        for a, _, _, z in brute_secrets(t):
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, z)
        return "".join([*out, t[at:]])

    want = {}
    for i, t in kept.items():
        want[i] = zlib.crc32(np.array(library.encode(redact(t), add_special_tokens=False).ids + [0], "<u4").tobytes())
    got = pipeline.run(spark, str(tmp_path)).toPandas()
    assert dict(zip(got.doc_id, got.ids_crc32)) == want
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "secret_scan", "best_fit_packing"]


def test_queries_are_registered():
    import __spark_entry__ as e

    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in e.queries()} and "pipeline" in e.queries()
