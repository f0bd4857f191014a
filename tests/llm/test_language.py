"""Hyperdimensional language profiles against a plain letter-by-letter version."""

import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from paneloom.llm import language

ROW = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("score", T.StringType()), T.StructField("lang_pred", T.StringType()), T.StructField("place", T.StringType())]
)
SYLLABLES = {"one": "the ing and tion ou er".split(), "two": "sch ung ein ö ß heit".split(), "three": "ción ñ que los ar de".split()}


def prose(lang, seed, words=60):
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randint(1, 4))) for _ in range(words)) + ". 12, 3!"


def plain_bundle(text):
    """Every letter's run bound for itself."""
    part = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in f" {(text or '').lower()} ")
    total = np.zeros(language.SIZE)
    for k in range(1, len(part) - 1):
        if part[k] != " ":
            a, b, c = language.letter_vectors(np.array([ord(x) for x in part[k - 1 : k + 2]])).astype(int)
            total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


def texts():
    odd = [None, "", " 12 !", "a", "é", "x" * 50, "́", "क्षि हिन्दी", "漢字かな交じり文", "İSTANBUL Σάς", "\U0001f600 ok", "a\nb\x00c"]
    return [prose(lang, n, 20) for lang in SYLLABLES for n in range(6)] + odd


def test_bundles_equal_the_plain_version(monkeypatch):
    some = texts()
    want = np.array([plain_bundle(t) for t in some])
    rows = list(range(len(some)))
    assert (language.summed([t or "" for t in some], rows, len(some)) == want).all()
    for name, value in (("PIECE", 5), ("LETTERS", 40), ("RUNS", 7), ("DENSE", 2)):
        monkeypatch.setattr(language, name, value)
        assert (language.summed([t or "" for t in some], rows, len(some)) == want).all()
    groups = [k % 3 for k in rows]
    assert (language.summed([t or "" for t in some], groups, 3) == np.array([want[g::3].sum(0) for g in range(3)])).all()
    assert abs(np.corrcoef(language.letter_vectors(np.arange(97, 123)))[~np.eye(26, dtype=bool)]).max() < 0.2


def test_predictions(spark):
    rows = [(i, prose(lang, i), lang) for n, lang in enumerate(SYLLABLES) for i in range(n * 40, n * 40 + 40)]
    rows += [(500 + k, t, None) for k, t in enumerate(texts())] + [rows[0], (None, prose("two", 9), "two"), (None, None, "one"), (900, "", "two"), (901, "7", "four")]
    rows += [(902, prose("three", 902, 40_000), None)]  # a very long one
    frame = spark.createDataFrame([(*r, "s", "l", "p") for r in rows], ROW)
    train = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 != 2]
    model = language.fit(frame.filter(language.fold(frame.doc_id) != 2))
    assert model[0] == sorted(SYLLABLES)
    for name, vector in zip(*model, strict=True):
        known = language.summed([t or "" for _, t, lang in train if lang == name], [0] * sum(lang == name for _, _, lang in train), 1)
        assert (vector == known[0]).all()
    got = language.predict(frame, model, keep=("doc_id", "lang")).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, text, _ in rows:
        r = by_id.get(i)
        if r is None or i == 902:
            continue
        if text is None or not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        v = plain_bundle(text)
        cosine = [v @ p / np.sqrt((v @ v) * (p @ p)) for p in model[1]]
        assert r["lang_pred"] == model[0][int(np.argmax(cosine))] and r["score"] == pytest.approx(max(0.0, *cosine), abs=1e-9)
    held = [r for r in got if r["lang"] in SYLLABLES and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["doc_id"] < 200]
    assert held and all(r["lang"] == r["lang_pred"] for r in held)
    assert by_id[902]["lang_pred"] == "three"


def test_nothing_learnt(spark):
    frame = spark.createDataFrame([(1, "words", None, "s", "l", "p"), (2, None, "one", "s", "l", "p"), (3, "12", "one", "s", "l", "p")], ROW)
    model = language.fit(frame)
    assert model[0] == []
    assert {(r["lang_pred"], r["score"]) for r in language.predict(frame, model).collect()} == {("und", 0.0)}
    assert language.predict(frame.limit(0), model).count() == 0


def test_accuracy_on_given_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.predict(documents, language.fit(documents.filter(language.fold(documents.doc_id) != 2)), keep=("doc_id", "lang")).collect()
    held = [r for r in rows if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 200 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
