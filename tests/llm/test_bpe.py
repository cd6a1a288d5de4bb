import hashlib

import public_tokenizers
import pytest

from goldseam.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", "a", " ", "  two  spaces ", "it's 12 o'clock!!\n\n  x\t y", "é ü   z", "plain words in a row, and more.\nNext line", "x" * 5000, "ab " * 40000, " \x1c x\x1f", "<|endoftext|> tail", "日本語 テキスト", "tail space "]


def test_encode_decode_match_the_library(spark, docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, ""), (None, "null id")]
    lib = bpe.encoding(RANKS)
    got = bpe.decode(bpe.encode(docs(rows), RANKS), RANKS).collect()
    assert sorted(bytes(r["decoded"]) for r in got) == sorted((t or "").encode() for _, t in rows)
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(docs(rows[: len(TEXTS)]), RANKS).collect()}
    assert ids == {i: lib.encode_ordinary(t or "") for i, t in rows[: len(TEXTS)]}


@pytest.mark.parametrize("text", ["x " * 70000 + " \n " + "y z " * 70000, "\n\n \n" * 3000])
def test_long_texts_are_cut_at_safe_boundaries_only(text):
    import numpy as np

    lib = bpe.encoding(RANKS)
    assert np.frombuffer(bpe.encoder(RANKS).encode(text), "<u4").tolist() == lib.encode_ordinary(text)


@pytest.mark.parametrize("blank", [" ", "\n", " \u3000", "\r\n"])
@pytest.mark.parametrize("around", [("", ""), ("a.", "b"), ("", "'s x"), ("word ", "")])
def test_runs_of_white_space_equal_the_library(blank, around):
    import numpy as np

    lib = bpe.encoding(RANKS)
    text = around[0] + blank * 100_000 + around[1] + blank * 6000 + "end" + blank * 20_000
    assert np.frombuffer(bpe.encoder(RANKS).encode(text), "<u4").tolist() == lib.encode_ordinary(text)


def test_millions_of_blanks_in_a_text(spark, docs):
    """More than the library's pattern can take in a row; tokenizers takes it, with the same vocabulary."""
    from tokenizers import Tokenizer

    from goldseam.llm.packing import tokenizer

    vocab = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(vocab)
    rows = [(1, " " * 4_000_000), (2, "a" + "\n" * 1_000_000 + "b"), (3, "x  y" + " " * 2_000_000 + "tail")]
    want = {i: own.encode(t, add_special_tokens=False).ids for i, t in rows}
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs(rows), RANKS).collect()}
    assert got == want
    import numpy as np

    ids, dtype = tokenizer(vocab)
    assert {i: np.frombuffer(ids(t), dtype).tolist() for i, t in rows} == want


def test_query_digests(spark, tmp_path):
    spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in bpe.op5_bpe(spark, str(tmp_path)).collect()}
    ids = bpe.encoding(RANKS).encode_ordinary("one two")
    assert got[1]["n_tokens"] == len(ids)
    assert got[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[1]["decoded_sha256"] == hashlib.sha256(b"one two").hexdigest()
    assert got[2]["n_tokens"] == 0 and got[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark, docs):
    assert bpe.encode(docs([]), RANKS).count() == 0
