import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grantscope.llm import queries
from grantscope.llm.packing import _squares, combinations, least_squares, pack, plan_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


def held(texts, end=0):
    tok = Tokenizer.from_file(PATH)
    return [np.array([*e.ids, *([] if end is None else [end])], "<u4") for e in tok.encode_batch(texts, add_special_tokens=False)]


def check(pieces, ids, window):
    """Every id of every document in one piece, every sequence gapless and unpadded; ids is by document id."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    assert set(docs) == set(ids)
    for doc, own in docs.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[doc])
            assert p.ids_crc32 == zlib.crc32(ids[doc][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[doc])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == window or at < window and at.bit_count() == 1
    return len(sequences)


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_against_the_library(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip([r.doc_id for r in rows], held([r.text or "" for r in rows]), strict=True))
    pieces = queries.op13_packing(spark, folder).collect()
    n = check(pieces, ids, 1024)
    tokens = sum(map(len, ids.values()))
    assert n <= tokens // 1024 + 11
    # fewer cuts than one long line of all documents has
    least = sum(-(-len(x) // 1024) for x in ids.values())
    assert len(pieces) - least < tokens // 1024 / 2


def test_small_windows_nulls_long_texts_and_partitions(spark):
    texts = [None, "", " ", "a", "word " * 70, "x" * 3000, "ünï 日本 " * 40, "a b c", "a b c", "a b c d e f g"] + [f"number {k} of some" for k in range(60)]
    rows = list(enumerate(texts))
    ids = dict(zip(range(len(texts)), held([t or "" for t in texts]), strict=True))
    for parts, window in ((1, 16), (7, 16), (3, 64), (2, 2)):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit("x"), "n": F.lit(1), "rest": F.lit(2)}).repartition(parts)
        assert check(pack(spark, df, tokenizer_path=PATH, window=window).collect(), ids, window)


def test_equal_and_null_ids_and_no_end(spark):
    df = spark.createDataFrame([(None, "some words"), (None, "some words"), (3, "some words"), (3, "other"), (4, "")], "doc_id long, text string")
    found = pack(spark, df, tokenizer_path=PATH, end_id=None, window=8).collect()
    one, other = (len(x) for x in held(["some words", "other"], None))
    assert sum(p.length for p in found) == 3 * one + other and {p.doc_id for p in found} == {None, 3}


def test_empty_table(spark):
    assert pack(spark, spark.createDataFrame([], "doc_id long, text string"), tokenizer_path=PATH).count() == 0


def test_combinations_and_their_sizes():
    for window in (2, 4, 16):
        found = [tuple(x) for x in combinations(window).tolist()]
        expected = {(0, b, window - b) for b in range(1, window // 2 + 1)} | {(a, b, window - a - b) for a in range(1, window) for b in range(a, window) if window - a - b >= b}
        assert len(found) == len(set(found)) and set(found) == expected
        squares = [sum(x.count(v) ** 2 for v in set(x) - {0}) for x in found]
        assert _squares(combinations(window)).tolist() == squares


def test_counts_come_as_near_as_a_plain_solver_s():
    rng = np.random.default_rng(2)
    for _ in range(5):
        h = rng.poisson(200, 32).astype(np.int64)
        h[0] = 0
        combos = combinations(32)
        a = np.zeros((32, len(combos)))
        for k, lengths in enumerate(combos.tolist()):
            for x in lengths:
                a[x, k] += 1
        a[0] = 0
        x = np.zeros(len(combos))
        for _ in range(20_000):  # projected gradient
            x = np.maximum(0, x - a.T @ (a @ x - h) / np.linalg.norm(a, 2) ** 2)
        own = least_squares(combos, h)
        assert (own >= 0).all() and np.linalg.norm(a @ own - h) <= np.linalg.norm(a @ x - h) + 10


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_remainder_once(seed):
    rng = np.random.default_rng(seed)
    h = rng.poisson([0.3, 3, 40, 0, 5, 1][seed], 64)
    h[0], h[40] = 0, [0, 500, 3000, 7, 0, 1][seed]
    plan = plan_of(h, 64)
    filled = defaultdict(list)
    for length in range(1, 64):
        for ordinal in range(h[length]):
            k = int(np.searchsorted(plan.keys, length << 44 | ordinal, "right")) - 1
            beyond = ordinal - int(plan.keys[k] & ((1 << 44) - 1))
            assert plan.keys[k] >> 44 == length and beyond >= 0
            at = [(0, length, int(plan.sequence[k]) + beyond, int(plan.offset[k]))] if plan.offset[k] >= 0 else list(plan.cut(int(plan.sequence[k]) + beyond * length, length))
            assert sum(x[1] for x in at) == length
            for _, size, number, offset in at:
                filled[number].append((offset, size))
    assert set(filled) == set(range(plan.last))
    for own in filled.values():
        end = 0
        for offset, size in sorted(own):
            assert offset == end
            end += size
        assert end == 64 or end.bit_count() == 1
