from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from goldseam.llm.bestfit import fill, fullest, pack_best_fit

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 30))
def test_combination_is_the_fullest(have, room):
    lengths = sorted(have)
    counts = [0] * 40
    for n, c in have.items():
        counts[n] = c
    taken = fullest(counts, lengths, room)
    sums = [sum(n * m for n, m in zip(lengths, ms, strict=True)) for ms in product(*(range(counts[n] + 1) for n in lengths))]
    assert sum(taken) == max(s for s in sums if s <= room)
    assert all(c <= counts[n] for n, c in Counter(taken).items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_every_piece_once_and_no_more_sequences_than_first_fit(lengths):
    found = list(fill(np.array(lengths, np.int64), 50))
    assert sorted(p for s in found for p in s) == list(range(len(lengths)))
    assert all(sum(lengths[p] for p in s) <= 50 for s in found)
    # the slack of each sequence is minimal for what was left when it was made
    left = list(lengths)
    for s in found:
        own = [lengths[p] for p in s]
        assert max(own) == max(left)
        rest = left.copy()
        rest.remove(max(own))
        sums = 1
        for n in rest:
            sums |= sums << n
        best = max(b for b in range(51 - max(own)) if sums >> b & 1)
        assert sum(own) == max(own) + best
        for n in own:
            left.remove(n)


def test_many_pieces_leave_hardly_any_padding():
    lengths = np.random.default_rng(1).integers(1, 1024, 50_000)
    found = list(fill(lengths, 1024))
    # no packing has fewer than the tokens need, or than there are pieces of which no two fit together
    assert len(found) <= max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum())) * 1.001
    small = np.random.default_rng(2).integers(1, 700, 50_000)
    assert len(list(fill(small, 1024))) <= -(-int(small.sum()) // 1024) + 3


def test_whole_texts_in_gapless_sequences(spark, docs):
    own = Tokenizer.from_file(VOCAB)
    rng = np.random.default_rng(3)
    words = ["alpha", "be", "Γάμμα", "d,", "\n\n", "zero123", "<|endoftext|>"]
    table = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(80)]
    table += [(100, None), (101, ""), (None, "no id"), (3, "again"), (3, "again"), (102, "long " * 9000), (103, "x" * 200_000)]
    got = pack_best_fit(docs(table), VOCAB, 64, group=40).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
    want = defaultdict(list)
    for i, t in table:
        want[i].append([*own.encode(t or "", add_special_tokens=False).ids, 2])
    for i, texts in want.items():
        if len(texts) == 1:
            parts = sorted(pieces[i])
            assert [p[0] for p in parts] == list(range(len(parts)))
            assert [p[1] for p in parts] == np.cumsum([0, *(p[2] for p in parts[:-1])]).tolist()
            assert np.frombuffer(b"".join(p[3] for p in parts), "<u4").tolist() == texts[0]
            assert all(p[2] == 64 for p in parts[1:]) and len(parts) == -(-len(texts[0]) // 64)
        else:
            assert sum(p[2] for p in pieces[i]) == sum(map(len, texts))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(x) for t in want.values() for x in t)
    assert len(sequences) <= -(-total // 64) + 2 * 3  # two for each of three groups


def test_empty_table(spark, docs):
    assert pack_best_fit(docs([]), VOCAB).collect() == []


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001"])
def test_query(spark, sf_dir):
    from goldseam.llm.bestfit import op12_bestfit

    got = op12_bestfit(spark, sf_dir).toPandas()
    used = got.groupby("sequence_id")["length"].sum()
    assert used.max() <= 1024 and len(used) <= -(-got["length"].sum() // 1024) * 1.02 + 1
