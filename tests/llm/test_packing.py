"""Packing: exact ids, gapless sequences, and as few of them as best fit gives."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import OPENED, PIECES, PLACED, best_fit, pack, sweep, token_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            g = min(fits)
            gaps.remove(g)
            gaps.append(g - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def sequences(runs, lengths):
    """Contents of each sequence under PLACED runs; every piece once, gapless."""
    counts, used, done = Counter(lengths), defaultdict(list), Counter()
    for size, rank, n, each, first, offset in runs:
        for r in range(rank, rank + n):
            used[first + (r - rank) // each].append((offset + (r - rank) % each * size, size))
            done[size, r] += 1
    assert set(done.values()) <= {1} and Counter(size for size, _ in done) == counts
    return used


def check_gapless(used, capacity):
    for items in used.values():
        at = 0
        for start, length in sorted(items):
            assert start == at
            at += length
        assert at <= capacity


def made_lengths(rng, capacity):
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 120))]
    return lengths + [rng.randint(1, capacity)] * (50 if rng.random() < 0.5 else 0)


def test_one_sweep_is_best_fit_decreasing():
    rng = random.Random(2)
    for capacity in (10, 37, 100):
        for _ in range(40):
            lengths = made_lengths(rng, capacity)
            runs = [(PIECES, size, 0, n, 0, 0, 0) for size, n in Counter(lengths).items()] + [(OPENED, 0, 0, 0, 0, 0, 0)]
            out = sweep(runs, capacity, last=True)
            used = sequences([r[1:] for r in out if r[0] == PLACED], lengths)
            check_gapless(used, capacity)
            assert len(used) == best_fit_decreasing(lengths, capacity)


def test_supersteps_are_as_good(spark):
    rng = random.Random(3)
    total = best = 0
    for capacity, n in ((64, 400), (100, 900), (37, 50), (512, 3000)):
        lengths = [min(capacity, max(1, int(rng.lognormvariate(0, 1.1) * capacity / 4))) for _ in range(n)] + [capacity // 3] * (n // 3)
        counts = spark.createDataFrame(list(Counter(lengths).items()), "size bigint, n bigint")
        runs = [(r["size"], r["rank"], r["n"], r["each"], r["first"], r["offset"]) for r in best_fit(counts, capacity).collect()]
        used = sequences(runs, lengths)
        check_gapless(used, capacity)
        assert sorted(used) == list(range(len(used)))
        total, best = total + len(used), best + best_fit_decreasing(lengths, capacity)
    assert total <= best * 1.01


@pytest.mark.parametrize("seed", range(3))
def test_token_bytes_equal_the_tokenizer(seed):
    rng = random.Random(seed)
    alphabet = "aÀé.,'sSt1 \n\tß<|>-_ªΣ日́ "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["foo<|endoftext|>bar <|ENDOFTEXT|>.", "İstanbul. It's, x..", "a\x1cb\x0bc d"]
    tokenizer = Tokenizer.from_file(PATH)
    for text, data in zip(texts, token_bytes(texts, PATH, at_once=100)):
        assert np.frombuffer(data, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_pieces_and_sequences(documents):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["cat", "dog", "tree", "zebra-like"]) for _ in range(rng.randint(0, 60)))) for k in range(200)]
    rows += [(1000, "cat " * 300), (1001, None), (1002, ""), (None, "cat dog"), (5, rows[5][1]), (5, rows[5][1])]
    found = pack(documents(rows), PATH, capacity=64).collect()
    tokenizer = Tokenizer.from_file(PATH)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
    assert by_doc.keys() == texts.keys()
    for i, pieces in by_doc.items():
        ids = np.array(tokenizer.encode(texts[i][0], add_special_tokens=False).ids + [1], "<u4")
        assert len(pieces) == len(texts[i]) * -(-len(ids) // 64)
        for r in pieces:
            part = ids[r.start : r.start + r.length]
            assert r.start == 64 * r.piece and len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for items in by_sequence.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_sequence) <= best_fit_decreasing([r.length for r in found], 64) * 1.01 + 1


def test_empty_table(documents):
    assert pack(documents([]), PATH).count() == 0
