import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from ledgerloom.llm.packing import cuts, pack

BYTES = Tokenizer.from_file(path("byte_bpe_50k.json"))


@pytest.mark.parametrize("n", [*range(1, 200), 1023, 1024, 1025, 2047, 2048, 2049, 10_000])
def test_cuts(n):
    pieces = cuts(n)
    assert sum(pieces) == n and all(0 < p <= 2048 for p in pieces)
    # All but the last leave next to nothing of a window of their class.
    assert all(2048 - 2048 // p * p <= 2048 // p for p in pieces[:-1])
    assert pieces[-1] < 64 or 2048 - 2048 // pieces[-1] * pieces[-1] <= 32
    assert len(pieces) <= n // 2048 + 4


def test_round_trip(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma,", "x1", "é"]) for _ in range(rng.choice([0, 1, 5, 50, 400, 3000]))) for _ in range(150)] + [None, "", "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(3, "again", 0), (None, "null id", 0)], "doc_id long, text string, rank int")
    want = [(i, np.array([*BYTES.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in [*enumerate(texts), (3, "again"), (None, "null id")]]
    rows = pack(docs).collect()
    left = sorted(((str(i), ids.tobytes()) for i, ids in want))
    crcs = {(str(i), start, zlib.crc32(ids[start : start + n].tobytes())) for i, ids in want for start, n in zip(np.cumsum([0, *cuts(len(ids))[:-1]]).tolist(), cuts(len(ids)), strict=True)}
    assert {(str(r.doc_id), r.start, r.ids_crc32) for r in rows} == crcs
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in want) and len(left) == len(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    waste = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        waste += 0 if at & (at - 1) == 0 else 2048 - at
    assert sorted(sequences) == list(range(len(sequences)))
    assert waste <= 2048 + 64 * len(sequences)


def test_pieces_of_a_very_long_text(spark):
    text = "alpha beta Gamma, x1 é " * 60_000
    ids = np.array([*BYTES.encode(text, add_special_tokens=False).ids, 1], "<u4")
    rows = sorted(pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *[r.length for r in rows[:-1]]]).tolist() and rows[-1].start + rows[-1].length == len(ids)
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in rows)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
