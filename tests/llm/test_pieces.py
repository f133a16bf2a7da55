"""Operator 3 against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from saleslens.llm import pieces  # noqa: E402
from saleslens.llm.queries import tokenizer_path  # noqa: E402

ODD = [
    "", " ", "  ", "a", " a  b ", "\n", "a\nb", "▁", "▁a ▁", "a▁b", "😀 x😀😀", "\x00a", "</s> <s><unk> <0x41>", "\ufffd é",
    "a" * 500, "x " * 300, "日本語テスト", "\t\t a", "ab \n cd", " \n", "é", "word\xa0nb", " ▁ ▁▁  z", "⁇", "🇩🇪 \U000fffff",
    "aaaaaaaaaa" * 20 + " " + "thethethe" * 30, "don't stop, 1,234.5!?", "Ünïcödé—dash…",
]


@pytest.fixture(scope="module")
def blob():
    return pieces.read_model(tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library(blob):
    return sentencepiece.SentencePieceProcessor(model_proto=blob)


def texts():
    draw = random.Random(5)
    letters = "abcdefgh ABC  \n,.é▁'0123"
    return ODD + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 80))) for _ in range(300)]


def test_ids_and_decoding_equal_the_library(blob, library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_SIZE", 50)  # also while the memory turns over
    model = pieces.PieceModel(blob)
    given = texts()
    for at in range(0, len(given), 40):
        for text, (ids, _, _, decoded) in zip(given[at : at + 40], model.encode_many(given[at : at + 40]), strict=True):
            expected = library.encode(text)
            assert ids.tolist() == expected, text
            assert decoded == library.decode(expected), text
            assert model.decode(expected) == library.decode(expected), text


def test_spans_cover_the_text_in_order(blob, library):
    model = pieces.PieceModel(blob)
    for text in texts():
        ids, first, last, _ = model.encode(text)
        raw, at = text.encode(), 0
        for i, a, b in zip(ids.tolist(), first.tolist(), last.tolist(), strict=True):
            assert a in (at, first[0]) or i in model.byte_of
            if i not in model.byte_of:
                piece = model.pieces[i].replace("▁", " ").encode()
                assert raw[a:b].decode().replace("▁", " ").encode() in (piece, piece[1:])
            at = max(at, b)
        assert at == len(raw)


def test_normalisation_with_a_compiled_map():
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = dict(pieces._fields(normalizer.serialized_model_proto()))[3]
    own = pieces.Normalizer(spec)
    for text in ["ＡＢＣ  ①½ é ﬁ", " a  b ", "ｶﾞ ㌔", "e\u0301 a\u030a", "", " ", "日本\u3000語", "\U0001d49cb", "x\xad y"]:
        norm, first, end = own(text)
        assert norm == normalizer.normalize(text)
        assert all(0 <= a <= b <= len(text.encode()) for a, b in zip(first, end))
        assert first == sorted(first)


def test_digests(spark, blob, library, docs_of):
    rows = [(1, "Hello  world"), (1, "Hello  world"), (None, "naïve ▁ x"), (3, None), (4, ""), (5, "long " * 40_000)]
    got = {(r.doc_id, r.ids_sha256): r for r in pieces.encoding_digests(docs_of(rows), blob).collect()}
    assert len(got) == 5
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        r = got[i, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()]
        assert r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert r.span_bytes == len((t or "").encode())
    assert pieces.encoding_digests(docs_of(rows).limit(0), blob).collect() == []


def test_decoding_comes_from_the_ids(blob, library):
    model, draw = pieces.PieceModel(blob), random.Random(5)
    text = "the same words, the same words"
    ids, _, _, back = model.encode(text)
    assert back == text
    # another id for a word that the model remembers shows in what is decoded
    chunk = next(c for c in model.young if "words" in c)
    table = np.frombuffer(model.young[chunk], dtype=np.int32).reshape(-1, 3).copy()
    table[-1, 0] = model.ids["s"] if table[-1, 0] != model.ids["s"] else model.ids["e"]
    model.young[chunk] = table.tobytes()
    changed, _, _, back = model.encode(text)
    assert back != text and back == library.decode([int(i) for i in changed])
    byte_ids = list(model.byte_of)
    for _ in range(300):
        some = [draw.choice([draw.randrange(len(model.pieces)), draw.choice(byte_ids), model.end, 0]) for _ in range(draw.randint(0, 12))]
        assert model.decode_ids(np.array(some, dtype=np.int32)) == library.decode(some)
