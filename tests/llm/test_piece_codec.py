import hashlib
import random

import pytest
import sentencepiece

from tasklathe.llm import piece_codec as C
from tasklathe.llm import registry
from tasklathe.llm.sparkio import table

P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as file:
        return C.PieceCodec(file.read())


EDGES = ["", " ", "  a  b", "a\n b", "▁x", "▁▁", "é́ ﬁ Ａ", "a\tb\x00c", "<s> hi </s> <unk> <0x0A>", "　x", "a\xa0b", "😀 hi", " " * 1000 + "a", "\n\n\n", "a" * 5000, "é" * 3000, "m².", "�", "x²y ½"]


def test_edges_against_the_library(codec):
    ids = [codec.encode(t) for t in EDGES]
    codec.check(EDGES, ids, [codec.decode(i) for i in ids])


def test_random_texts_against_the_library(codec):
    rng = random.Random(1)
    letters = "ab the  ▁\n\tééß梦😀Aing\x00.,0123<s>²"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(4000)]
    ids = [codec.encode(t) for t in texts]
    codec.check(texts, ids, [codec.decode(i) for i in ids])


def test_cuts_do_not_change_the_agenda(codec):
    for text in ["The quick  brown fox, jumps.\nOver", "x1y2  z, (a)"]:
        whole = codec._cut_ids(C.SPACE + text.replace(" ", C.SPACE))
        assert codec.encode(text, marks=False) == whole


def test_a_difference_raises(codec):
    with pytest.raises(ValueError, match="differ"):
        codec.check(["a b"], [codec.encode("a c")], ["a c"])


def test_query_against_the_library(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = registry.op10_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_null_repeats_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, None, "p"), (1, "", "q"), (2, "Hi", None), (2, "Hi", None)], "doc_id long, text string, decoded string")
    got = C.encode_texts(frame, PATH).collect()
    assert [(r.n_tokens, r.decoded) for r in got][:2] == [(2, ""), (2, "")]
    assert got[2] == got[3] and got[2].decoded == "Hi"
    assert C.encode_texts(frame.limit(0), PATH).count() == 0


def test_agenda_of_many_is_each_ones_own(codec):
    rng = random.Random(3)
    letters = "thereandingouly▁ 1.,é²"
    cuts = list({"".join(rng.choice(letters).replace(" ", C.SPACE) for _ in range(rng.randrange(1, 40))) for _ in range(3000)})
    together = codec.pairs.encode(cuts)
    assert len(together) > 1500 and all(codec._cut_ids(c) == ids for c, ids in together.items())


def test_generations_forget_without_harm(codec, monkeypatch):
    monkeypatch.setattr(C, "REMEMBERED", 20)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", f"w{rng.randrange(99)}x"]) for _ in range(12)) for _ in range(200)]
    ids = [i for k in range(0, 200, 10) for i in codec.encode_all(texts[k : k + 10])]
    codec.check(texts, ids, [codec.decode(i) for i in ids])
