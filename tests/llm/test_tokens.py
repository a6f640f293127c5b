import random

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import packing, token_count
from tests.llm.cases import ROWS, documents, empty, odd

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
BYTES = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [" ", "  ", "\n", "\t", "\r", "▁", "a", "the", "Ing", "<s>", "</s>", "<unk>", "é", "中", "\x00", "🙂", ".", "\xa0",
       "<0x0A>", "ﬁ", "’s", "'s", "'LL", "12", "　", "<|endoftext|>", "ß", "́"]


def test_pieces_add_up():
    own, model, r = sentencepiece.SentencePieceProcessor(model_file=MODEL), token_count.load(MODEL), random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice(ODD) for _ in range(r.randint(0, 12)))
        assert sum(token_count.count_pieces(model, token_count.pre_tokens(text))) == len(own.encode(text)), text


def test_counts_equal_the_library(spark, sf):
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {r["doc_id"]: (len(r["text"].encode()), len(own.encode(r["text"]))) for r in documents(spark, sf).collect()}
    for share in (1e-6, 1e-2):  # nearly all pre-tokens sent ahead; nearly all met by hash
        got = token_count.token_counts(documents(spark, sf), MODEL, share=share)
        assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got.collect()} == want


def test_counts_of_odd_rows(spark):
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_count.token_counts(odd(spark), MODEL).collect())
    assert got == sorted((str(i), len((t or "").encode()), len(own.encode(t or ""))) for i, t, *_ in ROWS)
    assert token_count.token_counts(empty(spark), MODEL).count() == 0


def test_fast_ids_equal_the_files_own():
    own, enc, r = Tokenizer.from_file(BYTES), packing.encoder(BYTES), random.Random(2)
    assert enc.fast is not None
    for _ in range(3000):
        text = "".join(r.choice(ODD) for _ in range(r.randint(0, 12)))
        assert enc.ids(text) == own.encode(text, add_special_tokens=False).ids, text
    for first in range(0, 0x110000, 0x1000):  # every code point, between letters, digits and marks
        texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)} .{chr(c)}" for c in range(first, first + 0x1000, 7)
                 if not 0xD800 <= c < 0xE000]
        assert [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)] == [enc.ids(t) for t in texts]
