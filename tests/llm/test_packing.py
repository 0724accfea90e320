"""Packing: every token once, in order, in full windows."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallywork.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, packing.END_ID]


@pytest.mark.parametrize("window", [4096, 256])
def test_round_trip(hard_docs, hard_rows, window):
    rows = packing.pack(hard_docs, PATH, window=window).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for part in sequences.values():
        part.sort(key=lambda r: r.offset)
        assert [r.offset for r in part] == [sum(x.length for x in part[:k]) for k in range(len(part))]
        total = sum(r.length for r in part)
        assert total == part[0].window <= window and total & (total - 1) == 0
    want = defaultdict(int)
    for i, t in hard_rows:
        want[i, len(plain_ids(t))] += 1
    covered = defaultdict(int)
    ids = {i: plain_ids(t) for i, t in hard_rows if i is not None}
    for r in rows:
        covered[r.doc_id, r.doc_tokens] += r.length
        if r.doc_id is not None:
            cut = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
            assert zlib.crc32(cut) == r.ids_crc32
    assert covered == {k: k[1] * n for k, n in want.items()}


def test_ids_of_pieces_are_those_of_the_whole():
    words = packing.WordIds(open(PATH, encoding="utf-8").read(), most=3)
    for text in ("It's a  test\t\n<|endoftext|> x", "á é b c\x1cd", "ΣΑΣ İI", "", "don't   can't", "<|startoftext|>", "1234 5,6", "a\xa0b\x85c\u3000d", "Étude! naïve, ÀÖß ÿ ×÷", "e\u0301 cafe\u0301.", "a_b __ -- (x) [y] {z}~ `q`"):
        assert np.frombuffer(words.of(text), "<u4").tolist() == plain_ids(text)[:-1]


def test_steps_hold_the_same_number_of_tokens(spark):
    docs = spark.createDataFrame([(k, "word " * (5 + 37 * k % 900)) for k in range(200)], "doc_id long, text string").coalesce(1)
    per = defaultdict(int)
    for r in packing.pack(docs, PATH, window=512, steps=4).collect():
        per[r.step] += r.length
    assert len(per) > 5 and {per[k] for k in sorted(per)[:-1]} == {2048}


def test_tiers_have_windows_of_their_own_and_steps_mix_them(spark):
    docs = spark.createDataFrame([(k, "word " * (3 + 53 * k % (700 if k % 8 == 0 else 90))) for k in range(4000)], "doc_id long, text string").repartition(3)
    windows, steps = {}, defaultdict(lambda: defaultdict(int))
    rows = packing.pack(docs, PATH, window=512, steps=16).collect()
    for r in rows:
        assert windows.setdefault(r.sequence_id, (r.window, r.step)) == (r.window, r.step)
    for size, step in windows.values():
        steps[step][size] += 1
    sums = {k: sum(size * n for size, n in of.items()) for k, of in steps.items()}
    last = max(sums)
    assert set(sums) == set(range(last + 1)) and last > 5 and {sums[k] for k in range(last)} == {16 * 512} and 0 < sums[last] <= 16 * 512
    assert {size for size, _ in windows.values()} >= {512, 128, 64}
    for size in (512, 128, 64):  # each step has its share, but for what a bundle holds
        tokens = [steps[k][size] * size for k in range(last)]
        assert max(tokens) - min(tokens) <= 2 * 512
    # A short document is whole in one window unless it is the one cut to fill it.
    whole = sum(r.length == r.doc_tokens for r in rows if r.doc_tokens <= 512)
    assert whole > 0.6 * sum(r.doc_tokens <= 512 and r.start == 0 for r in rows)


def test_other_vocabularies_are_encoded_whole():
    from tokenizers import models, pre_tokenizers

    alphabet = {c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    cased = Tokenizer(models.BPE(vocab=alphabet, merges=[]))
    cased.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    words = packing.WordIds(cased.to_str())
    assert not words.by_pieces and packing.WordIds(open(PATH, encoding="utf-8").read()).by_pieces
    for text in ("The Cat  sat", "", " x\n"):
        assert np.frombuffer(words.of(text), "<u4").tolist() == cased.encode(text, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        packing.Packer(1000, 0)


def test_empty_table(no_docs):
    assert packing.pack(no_docs, PATH).count() == 0
