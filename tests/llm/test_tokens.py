"""Token files, packing and counts against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers as vocabularies
import pytest
from tokenizers import Tokenizer

import pyarrow as pa

from paneloom.llm import shared
from paneloom.llm.chunks import Encoder, concatenated, library, plain_words
from paneloom.llm.packing import assign, pack
from paneloom.llm.shared import by_bytes, scratch
from paneloom.llm.token_counts import count_tokens
from paneloom.llm.token_files import decode_values, encode_values, read_token_files, write_token_files

WORD, BYTE = vocabularies.path("word_bpe_49k.json"), vocabularies.path("byte_bpe_50k.json")
ATOMS = ["a", "B", "é", "É", "́", " ", "  ", "\n", "\t", "\xa0", ".", ",", "!", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "Σ", "İ", "1", "²",
         "汉", "​", "\x1c", "\0", "... ", " , ", ",\n", ".\n", "ß", "🙂", "ﬁ ", "don't ", "\r\n", "ſ", "word ", "The "]
ROWS = [
    (3, "The quick brown fox, it jumps. Over!\nA lazy dog.", "a"), (1, None, "b"), (2, "", None), (2, "", None), (None, "no id, two words", "a"),
    (5, "Repeated row.", "b"), (5, "Repeated row.", "b"), (4, "long " * 30_000, "c"), (9, "x" * 5_000 + " <|endoftext|> end", "c"),
]


def texts(count):
    draw = random.Random(5)
    return ["".join(draw.choice(ATOMS) for _ in range(draw.randint(0, 14))) for _ in range(count)]


def ids_of(path, text, end=(1,)):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + list(end)


@pytest.mark.parametrize(("path", "lowered"), [(WORD, True), (BYTE, False)])
def test_words_joined_give_the_ids_of_whole_texts(path, lowered):
    encode, specials = library(path)
    encoder = Encoder(encode, specials, concatenated, lowered)
    cases = texts(4000)
    whole = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(cases, add_special_tokens=False)]
    assert encoder.batch(cases) == whole
    assert encoder.batch(cases[:50]) == whole[:50] and encoder.batch([]) == []


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_plain_words_have_the_ids_that_the_library_gives(path):
    encode, specials = library(path)
    tokenizer = Tokenizer.from_file(path)
    plain = plain_words(tokenizer, specials)
    letters = [chr(c) for c in range(0x370) if chr(c).isalpha()]
    draw = random.Random(7)
    words = [draw.choice(["", " "]) + "".join(draw.choices(letters, k=draw.randint(1, 12))) for _ in range(3000)]
    words += ["word", " word", "Word", "two words", "don't", "o'clock", "a1", "ﬁ", "", " ", "\nx", "x\n", "e\u0301"]
    assert encode(words) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(words, add_special_tokens=False)]
    assert plain.fullmatch("word") and plain.fullmatch("é") and bool(plain.fullmatch(" word")) == (path == BYTE)
    assert not any(map(plain.fullmatch, ["", " ", "two words", "don't", "a1", "\nx", "x\n", "e\u0301"]))
    assert plain_words(tokenizer, ("end",)) is None  # a special string of letters could stand in a word


@pytest.mark.parametrize(("path", "lowered"), [(WORD, True), (BYTE, False)])
def test_marks_send_a_text_the_plainer_way_only_beside_a_split_off_stop(path, lowered):
    encode, specials = library(path)
    encoder = Encoder(encode, specials, concatenated, lowered)
    cases = ["Marks!! (in) words%%% here, \"and\" there.\n(So) on. -- Yes", "first%%%", "(one) two. (three) four, !five"]
    assert encoder.batch(cases) == [np.array(ids_of(path, t, ()), "<u4").tobytes() for t in cases]
    assert not encoder.joined.now  # no text was split twice
    beside = ["one!!. Two", "one%%%, two", "a \"b\". c", "one -. two"]
    assert encoder.batch(beside) == [np.array(ids_of(path, t, ()), "<u4").tobytes() for t in beside]
    assert encoder.joined.now


def test_slices_of_text_release_what_they_took(monkeypatch):
    released = []
    monkeypatch.setattr(shared, "release", lambda: released.append(1))
    batch = pa.RecordBatch.from_pydict({"text": ["ab", None, "cdef", "g"]})
    assert [p.column("text").to_pylist() for p in by_bytes(batch, "text", 4)] == [["ab", None], ["cdef"], ["g"]]
    assert len(released) == 3


def test_variable_length_values_round_trip():
    values = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(values) + 1):
        control, data = encode_values(values[:n])
        back = decode_values(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n)
        assert back.tolist() == values[:n].tolist()


def test_token_files(spark, documents):
    folder = scratch(spark, "test-token-files")
    files = write_token_files(documents(ROWS), WORD, folder, file_tokens=1000)
    assert files.count() >= 2
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read_token_files(files, folder).collect())
    start, want = 0, []
    for doc_id, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(WORD, text)
        want.append((start, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in read_token_files(files, folder, with_ids=True).collect()}
    assert ids[3] == ids_of(WORD, ROWS[0][1])
    empty = scratch(spark, "test-no-token-files")
    assert read_token_files(write_token_files(documents([]), WORD, empty), empty).count() == 0


def test_counts(spark, documents):
    rows = ROWS + [(100 + i, t, "f") for i, t in enumerate(texts(300))]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in count_tokens(documents(rows), BYTE, vocabularies.PATTERN).collect())
    assert got == sorted((str(i), len((t or "").encode()), len(ids_of(BYTE, t, ()))) for i, t, _ in rows)
    assert count_tokens(documents([]), BYTE, vocabularies.PATTERN).count() == 0


def test_assignment_is_balanced_gapless_and_tight():
    lengths = np.random.default_rng(3).integers(1, 6000, 700)
    pieces = np.array(assign(lengths, 2048))
    doc, start, length, seq, offset = pieces.T
    for d in range(len(lengths)):
        own = sorted(zip(start[doc == d], length[doc == d], strict=True))
        assert sum(n for _, n in own) == lengths[d]
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
    for s in np.unique(seq):
        own = sorted(zip(offset[seq == s], length[seq == s], strict=True))
        assert own[0][0] == 0 and own[-1][0] + own[-1][1] <= 2048
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
    assert len(np.unique(seq)) == -(-int((lengths % 2048).sum()) // 2048) + int((lengths // 2048).sum())
    assert not assign(np.zeros(0, np.int64), 2048)


def test_packing(spark, documents):
    rows = pack(documents(ROWS), BYTE, with_ids=True).collect()
    for doc_id, text, _ in ROWS:
        own = sorted(((r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"], r["ids_crc32"]) for r in rows if r["doc_id"] == doc_id))
        ids = ids_of(BYTE, text)
        copies = sum(r[0] == doc_id for r in ROWS)
        assert sum(n for _, n, *_ in own) == copies * len(ids) and all(n == len(ids) for *_, n, _ in own)
        whole = np.array(ids, "<u4").tobytes()
        assert all(b == whole[4 * s : 4 * (s + n)] and c == zlib.crc32(b) for s, n, b, _, c in own)
    assert pack(documents([]), BYTE).count() == 0
