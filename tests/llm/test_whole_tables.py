"""Licenses however they are wrapped, all rows of a query id, all languages."""

import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("voxelwave.llm")
pytest.importorskip("public_tokenizers")

from voxelwave.llm import langid, licenses, queries, topk  # noqa: E402

MIT = """MIT License

Copyright (c) 2020 A. Writer

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice."""
ISC = """Copyright (c) 2020, A. Writer

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
WRAPPED = {"MIT-text": MIT, "BSD-text": BSD, "ISC-text": ISC}


def test_wrapped_licenses():
    kinds = lambda t: {f.license for f in licenses.findings(t)}
    for name, text in WRAPPED.items():
        for width in (30, 50, 80):
            parts = [textwrap.fill(p, width) for p in text.split("\n\n")]
            for lead in ("", "# ", "        * "):
                t = "some prose\n" * 9 + "\n".join(lead + line for line in "\n\n".join(parts).split("\n")) + "\nmore prose" * 9
                assert name in kinds(t), (name, width, lead)
    assert kinds("Released under the\nMIT License.") == {"MIT"}
    twice = [f for f in licenses.findings(BSD + "\nprose" * 12 + "\n" + BSD) if f.license == "BSD-text"]
    assert len(twice) == 2 and not any(f.missing for f in twice) and twice[0].end < twice[1].start
    assert BSD[twice[0].start : twice[0].end] == "\n".join(BSD.split("\n")[:2])


def test_spdx_tags():
    kinds = lambda t: [f.license for f in licenses.findings(t)]
    assert kinds("// SPDX-License-Identifier: MIT\nint x;") == ["MIT-spdx"]
    assert sorted(kinds("# SPDX-License-Identifier: (MIT OR Apache-2.0)")) == ["Apache-2.0-spdx", "MIT-spdx"]
    assert kinds("/* SPDX-License-Identifier: GPL-2.0-only */\nMIT and ISC are names") == ["GPL-2.0-only-spdx"]
    assert kinds("SPDX-License-Identifier: none\nMIT") == []


def test_topk_ranks_all_rows_of_a_query_id(spark):
    duckdb = pytest.importorskip("duckdb")
    r = np.random.default_rng(8)
    rows = [(i % 70, [float(np.float32(v)) for v in r.normal(size=5)]) for i in range(120)]
    rows += [(20, rows[20][1]), (40, [1.0, 2.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.search(v, v.where("id % 20 = 0"), 20, block=16, query_block=2).select("query_id", "rank", "vec_id", "score").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(map(tuple, got)) == sorted(con.sql(queries.oracle_sql()["op7_topk"]).fetchall())


def test_every_language_is_learned(spark, monkeypatch):
    rows = [(k * 100 + i, "".join(chr(0x4E00 + 40 * k + (i * 7 + j * 3) % 40) for j in range(30)), f"l{k:02}") for k in range(70) for i in range(12 + 4 * (k < 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learning = df.select(F.col("doc_id").alias("id"), "text", "lang")
    model = langid.learn(learning)
    got = langid.predict_batch(model, [r[1] for r in rows])[0]
    wrong = [r[2] for r, g in zip(rows, got) if g != r[2]]
    assert len(model.langs) == 70 and not wrong, wrong
    monkeypatch.setattr(langid, "MAX_ROWS", 70)
    few = langid.sample(learning)
    assert len(few) == 70 and len({r[0] for r in few}) == 70
