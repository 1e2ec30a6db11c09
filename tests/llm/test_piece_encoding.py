"""Piece encoding and decoding against the library, and odd rows."""

import hashlib
import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

from veritrove.llm import piece_encoding
from veritrove.llm.piece_encoding import PieceModel, encode_pieces, encoded

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", " a", "a ", "\n", "\t　x\xa0", "▁x ▁", "<s> </s> <0x0A> <unk>", "\x00a", "漢字🙂é́", "ﬁ ¹²³m²x", "x" * 20_000, " " * 9_000, "漢字" * 5_000, "a b", "a b"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def expected(library, text):
    ids = library.encode(text or "", add_eos=True)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))


def test_random_texts(library):
    m, r = PieceModel.of(PATH), random.Random(7)
    entries = [p for p in m.pieces if len(p) > 2]
    for k in range(3000):
        if k % 2:
            text = "".join(r.choice(" ▁\tabcdehinst.,\n漢é🙂0 1\x00́xX²  ") for _ in range(r.randint(0, 40)))
        else:
            text = "".join(r.choice(entries)[: r.randint(1, 9)] for _ in range(r.randint(1, 12)))
        ids = library.encode(text, add_eos=True)
        assert m.encode(text) == ids
        assert m.decode(ids) == library.decode(ids)


def test_decoding_of_any_ids(library):
    m, r = PieceModel.of(PATH), random.Random(8)
    for _ in range(2000):
        ids = [r.choice([0, 1, 2, 3, 13, 130, 150, 153, 159, 200, 230, 240, 259, 264, 28705, r.randrange(32_000)]) for _ in range(r.randint(0, 9))]
        if 0 not in ids:
            assert m.decode(ids) == library.decode(ids)


def test_whole_texts_give_what_units_give():
    """The backtracking itself, without the cut into units, against merging anew."""
    m, r = PieceModel.of(PATH), random.Random(9)
    for _ in range(400):
        text = "".join(r.choice("▁▁▁aabbctheron,.0") for _ in range(r.randint(1, 40)))
        assert m.tokens(text) == m.merged(text)
    assert all(m.merged(p) == [p] for p in r.sample(sorted(m.valid), 500))


def test_units_end_before_other_characters_and_at_line_ends(library):
    """This model has entries from other characters to letters (.com), but none back, so a word is one unit whatever follows it."""
    m, r = PieceModel.of(PATH), random.Random(10)
    assert m.units("heat.\nThe heat,%% x.com  2²a_b\n\n") == ["▁heat", ".", "\n", "The", "▁heat", ",%%", "▁x", ".com", "▁▁2²a", "_b", "\n\n"]
    words = ["heat", "The", ".com", "über", "don't", "x²", "漢字", "0", "_", "▁", "é́", "🙂"]
    for _ in range(2000):
        text = "".join(r.choice(words) + r.choice(["", "", " ", ".", ",", "\n", ".\n", "%%%", "  "]) for _ in range(r.randint(1, 9)))
        ids = library.encode(text, add_eos=True)
        assert m.encode(text) == ids and m.decode(ids) == library.decode(ids)


def test_characters_of_entries_that_are_none_alone(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    for p in model.pieces:
        if p.piece in "qé":  # qu, é and others stay
            p.piece = {"q": "\ue000", "é": "\ue001"}[p.piece]
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    m, r = PieceModel(str(tmp_path / "m.model")), random.Random(11)
    library = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    assert sorted(m.part) == ["q", "é"]
    for _ in range(1000):
        text = "".join(r.choice(["q", "é", "qu", "e", "s", "t", " ", "🙂", "漢", "."]) for _ in range(r.randint(1, 20)))
        ids = library.encode(text, add_eos=True)
        assert m.encode(text) == ids and m.decode(ids) == library.decode(ids)


def test_rows(spark, library, monkeypatch):
    monkeypatch.setattr(piece_encoding, "KEPT_UNITS", 50)  # what is kept doesn't matter
    texts = [*ODD, *pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:60]]
    d = spark.createDataFrame([(k if k != 3 else None, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids_sha256 string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_pieces(d, PATH).collect()}
    assert got == {k if k != 3 else None: expected(library, t) for k, t in enumerate(texts)}
    whole = {r.doc_id: (r.ids, r.decoded) for r in encoded(d, PATH).collect()}
    assert whole[4] == (library.encode(" a", add_eos=True), " a") and whole[0] == ([2], "")
    assert encode_pieces(d.limit(0), PATH).collect() == []
