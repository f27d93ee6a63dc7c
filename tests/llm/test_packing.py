import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagewright.llm import packing


def check(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 300), max_size=25))
def test_plan_uses_the_histogram_exactly(counts):
    used, sequences = Counter(), 0
    for runs, times in packing.packing_plan(counts, 50):
        assert sum(n * m for n, m in runs) <= 50 and times > 0
        sequences += times
        for n, m in runs:
            used[n] += m * times
    assert used == Counter(counts)
    total = sum(n * c for n, c in counts.items())
    assert sequences <= 2 * -(-total // 50) + 1


def test_pieces_are_the_tokenizers_ids(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack_documents(docs).collect()
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for d in docs.collect():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k:k + 4096]
            want[d.doc_id, k // 4096, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert got == want
    check(rows, 4096)


def test_a_common_length_is_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 10)
    cut = spark.range(500).selectExpr("id div 2 AS doc_id", "0 AS piece", "0L AS start",
                                      "if(id % 5 = 0, 7L, 3L) AS length", "id AS ids_crc32")
    rows = packing.pack(cut, 10).collect()
    assert len(rows) == 500 and check(rows, 10) == 200  # 100 of 7 + 3, 100 of 3 + 3 + 3


def test_empty(no_docs):
    assert packing.pack_documents(no_docs).count() == 0


@pytest.mark.parametrize("text", ["it's", "''s re're !!'s", "A\tB\n\nc", "naïve Œuvre ŒŒ 12a½", "<|endoftext|>"])
def test_words_one_by_one(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    cache = packing.WordCache(path)
    assert cache.encode([text]) == cache.whole([text])


def test_words_encoded_together_equal_single_ones():
    cache = packing.word_cache(None)
    words = ["a", "'s", "'", "''", "zq7", "3", "l'été", "œuvre", "!?", "x" * 300] + [f"w{chr(97 + i % 26)}{'ab' * (i % 9)}" for i in range(2500)]
    assert cache.each(words) == cache.whole(words) and cache.each([]) == []
