import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from packetmill.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a", "a  b ", "Hello world", "naïve straße\n\nnew  line\tand tab", "日本語 😀 text", "a▁b ▁ c", "\x00\x01 \x7f",
         "x" * 5000, "one two " * 500, "end ", "\n lead", "<s> </s> <unk> <0x41>", "a  b c d", "ﬁ ｱ ①"]


def test_ids_spans_and_text_as_the_library(spark, frame, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + odd
    got = pieces.encode_documents(frame(rows), PATH).select("text", "n_tokens", "ids", "starts", "ends", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        text = r.text or ""
        want = [1, *sp.encode(text), 2]
        ids, starts, ends = (pieces.unpack(bytes(b)) for b in (r.ids, r.starts, r.ends))
        assert ids.tolist() == want and r.n_tokens == len(want) and r.decoded == sp.decode(want)
        raw = text.encode()
        assert (starts[1:] == ends[:-1]).all() and ends[-1] == len(raw)
        assert b"".join(raw[a:b] for a, b in zip(starts, ends)) == raw
        if len(text) < 200:
            proto = sp.encode(text, return_type="proto")
            for p, a, b in zip(proto.pieces, starts[1:], ends[1:]):
                if not sp.is_byte(p.id):
                    assert raw[a:b].decode() == p.surface
    assert pieces.encode_documents(frame(rows).limit(0), PATH).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf", "nfkc"])
@pytest.mark.parametrize("trim", [True, False])
def test_character_map(rule, trim):
    """Compiled maps against the library's own normaliser, text and alignment."""
    norm = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True,
                                                 remove_extra_whitespaces=trim)
    model = pieces.Model(norm.serialized_model_proto())
    assert model.units
    for text in TEXTS + ["  ＡＢＣ　①②  ﬁne é ㌔ ", "가가", "​zero", "ſt Ǆ"]:
        want, offsets = norm.normalize(text, with_offsets=True)
        got, source = model.normalise(text)
        assert got.decode() == want
        raw = text.encode()
        starts = np.flatnonzero([b & 0xC0 != 0x80 for b in got])
        assert [len(raw[:source[i]].decode()) for i in starts] == offsets[:len(starts)]


def test_digest_columns(spark):
    from packetmill.llm.queries import op1_piece_encoding

    row = op1_piece_encoding(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(f"doc_id = {row.doc_id}").first().text
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = [1, *sp.encode(text), 2]
    assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
