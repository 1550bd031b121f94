import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from postweave.llm import packing
from postweave.llm.packing import Tokens, best_fill, pack, plan

from .helpers import ODD, empty, odd


@pytest.fixture(scope="module")
def tokenizer():
    """The contract's tokenizer, untouched."""
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_tokenizers(tokenizer):
    own = Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    bits = ["the", " ", "  ", "\n", " \n", "\t", "don't", "É", "🙂", "漢字", "123", "!!", "<|endoftext|>", "a" * 60, "'s", " ", "\r\n"]
    for _ in range(1500):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert np.frombuffer(own.encode(text), np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_beside_any_white_space(tokenizer):
    """A space beside white space of any kind belongs to its run, whose merges may span it."""
    own = Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(own.encode("Hello. \xa0 \xa0 World"), np.uint32).tolist() == [15496, 13, 11504, 2159]
    assert np.frombuffer(own.encode("<|endoftext|> hi"), np.uint32).tolist() == [50256, 23105]
    rng = random.Random(7)
    bits = ["a", "the", " ", " ", "\xa0", "\u3000", "\u2009", "\u2028", "\u180e", "\u200b", "\n", "\t", "\x85", "\x1c", "\x1d", "\x1f", ".", "'s", "7", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert np.frombuffer(own.encode(text), np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_best_fill_is_best():
    rng = random.Random(2)
    for _ in range(200):
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, 15), 4)}
        room = rng.randint(0, 30)
        best = max(s for s in (sum(n * k for n, k in zip(counts, ks)) for ks in product(*[range(c + 1) for c in counts.values()])) if s <= room)
        used = best_fill(counts, room)
        assert sum(n * k for n, k in used.items()) == best and all(k <= counts[n] for n, k in used.items())


def first_fit_decreasing(counts, capacity):
    rooms = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        k = next((k for k, room in enumerate(rooms) if room >= n), None)
        if k is None:
            rooms.append(capacity - n)
        else:
            rooms[k] -= n
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece(seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(1, 50) for n in rng.sample(range(1, 101), 60)}
    used = defaultdict(int)
    windows = 0
    for times, own in plan(counts, 100):
        assert sum(n * k for n, k in own.items()) <= 100
        windows += times
        for n, k in own.items():
            used[n] += k * times
    assert used == counts and windows <= 1.02 * first_fit_decreasing(counts, 100)


def checked(rows, texts, tokenizer, capacity):
    ids = {k: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for k, t in texts}
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    assert sorted(seqs) == list(range(len(seqs)))
    return ids


def test_round_trip(spark, tokenizer):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices(["alpha", "be", "gamma,", "ünder", "\n"], k=rng.choice((0, 3, 40, 700))))) for i in range(60)]
    rows = pack(spark, spark.createDataFrame(texts, "doc_id long, text string"), capacity=64, keep_ids=True).collect()
    ids = checked(rows, texts, tokenizer, 64)
    got = defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        got[r.doc_id].append((r.start, bytes(r.ids)))
    assert {k: b"".join(x for _, x in sorted(v)) for k, v in got.items()} == {k: v.tobytes() for k, v in ids.items()}


def test_odd_rows(spark, tokenizer, monkeypatch):
    rows = pack(spark, odd(spark)).collect()
    assert sum(r.length for r in rows) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in ODD)
    checked(rows, [], tokenizer, 2048)
    assert pack(spark, empty(spark)).collect() == []
    own = Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(packing, "CACHE_WORDS", 2)
    assert own.encode("a b c d e f a b") == own.ids("a b c d e f a b") and len(own) <= 2
