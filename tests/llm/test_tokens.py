"""Token files, packing and sharding against plain computations on the same rows."""

from __future__ import annotations

import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from odd_documents import clashing, documents, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tachyline.llm import packing, sharding, token_files
from tachyline.llm.encoding import Encoder, default_tokenizer
from tachyline.plans.files import scratch_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=250, deadline=None)
@given(st.lists(st.text(alphabet="ab's,.9 \n\t\0 é字　", max_size=30), max_size=4))
def test_pieces_encode_as_whole_texts(texts):
    whole = Tokenizer.from_file(default_tokenizer()) if not hasattr(ids_of, "t") else ids_of.t
    ids_of.t = whole
    encoder = Encoder(default_tokenizer(), 2, most_pieces=8)
    for _ in range(2):
        got = [np.frombuffer(each, "<u4").tolist() for each in encoder.encode(texts)]
        assert got == [ids_of(whole, text) for text in texts]


def test_an_added_token_is_what_the_library_says(tokenizer):
    """By the plain call: the string of a special token is that token."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a <|endoftext| > b", "x<|endoftext|>y\nz", "plain"]
    got = [np.frombuffer(each, "<u4").tolist() for each in Encoder(default_tokenizer(), 2).encode(texts)]
    assert got == [ids_of(tokenizer, text) for text in texts] and got[0] == [64, 220, 50256, 275, 2]


def test_a_tokenizer_with_other_settings_takes_texts_whole(tmp_path, tokenizer):
    settings_ = json.loads(tokenizer.to_str())
    settings_["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(settings_))
    texts = ["two words here", " leading", "line\nbreak", ""]
    got = [np.frombuffer(each, "<u4").tolist() for each in Encoder(str(path), 2).encode(texts)]
    other = Tokenizer.from_file(str(path))
    assert got == [ids_of(other, text) for text in texts] and got[0] != ids_of(tokenizer, texts[0])


@pytest.mark.parametrize("most", [4, 300, 1_000_000])
def test_documents_encode_as_whole_texts(tokenizer, most):
    """All documents of a table, with a memory for pieces that starts afresh again and again, and one that doesn't."""
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    texts += [t or "" for _, t in odd_texts()] + [" ", "\n", "a\n", "\na", "a\n\nb c", "a  b", "tab\tx y", "x y\u3000z w", "é\n字 a"]
    encoder = Encoder(default_tokenizer(), 2, most_pieces=most)
    got = [np.frombuffer(each, "<u4").tolist() for each in encoder.encode(texts)]
    assert got == [ids_of(tokenizer, text) for text in texts]


def test_token_files_round_trip(spark, tokenizer):
    rows = odd_texts()
    folder = scratch_path(spark, "files")
    manifest = token_files.write_token_files(clashing(documents(spark, rows)), folder, partitions=3)
    got = token_files.read_token_files(manifest, folder).orderBy("start").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    assert len(got) == len(rows)
    for row, (doc_id, text) in zip(got, ordered):
        ids = ids_of(tokenizer, text)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_of_an_empty_table(spark):
    docs = documents(spark, [])
    assert token_files.encoded_documents(spark, docs).isEmpty()
    assert packing.pack_documents(docs).isEmpty()
    assert sharding.shard_documents(docs).isEmpty()


def check_packing(rows, capacity):
    sequences = defaultdict(list)
    for row in rows:
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing_of_odd_documents(spark, tokenizer):
    rows = odd_texts()
    got = packing.pack_documents(clashing(documents(spark, rows)), capacity=64).collect()
    expected = Counter()
    for doc_id, text in rows:
        ids = ids_of(tokenizer, text)
        bounds = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
            expected[doc_id, piece, a, b - a, crc(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    check_packing([r.asDict() for r in got], 64)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_placement_is_gapless_and_no_worse_than_best_fit_decreasing(lengths):
    runs = packing.placement(Counter(lengths), 40)
    rows, given = [], defaultdict(int)
    for size in lengths:
        rank = given[size]
        given[size] += 1
        at = max(i for i in range(len(runs["size"])) if runs["size"][i] == size and runs["rank"][i] <= rank)
        rows.append({"sequence_id": runs["sequence"][at] + rank - runs["rank"][at], "offset": runs["offset"][at], "length": size})
    used = check_packing(rows, 40)
    bins = []
    for size in sorted(lengths, reverse=True):
        fits = [i for i, load in enumerate(bins) if load + size <= 40]
        if fits:
            bins[max(fits, key=lambda i: bins[i])] += size
        else:
            bins.append(size)
    assert used <= len(bins)


def test_the_reduction_fixes_only_sets_of_some_optimum():
    random.seed(4)

    def optimum(items, capacity):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            seen = set()
            for b in range(len(bins)):
                if bins[b] + items[i] <= capacity and bins[b] not in seen:
                    seen.add(bins[b])
                    go(i + 1, bins[:b] + [bins[b] + items[i]] + bins[b + 1 :])
            go(i + 1, bins + [items[i]])

        go(0, [])
        return best[0]

    for _ in range(60):
        items = sorted((random.randint(1, 20) for _ in range(9)), reverse=True)
        counts = np.bincount(items, minlength=21)
        fixed = packing.reduced(counts, 20)
        rest = [size for size in range(20, 0, -1) for _ in range(counts[size])]
        assert sum(times for _, times in fixed) + optimum(rest, 20) == optimum(items, 20)


def test_large_packing_is_near_the_bound():
    random.seed(5)
    lengths = [random.randint(1, 1024) for _ in range(20_000)]
    runs = packing.placement(Counter(lengths), 1024)
    ends = runs["sequence"].max()
    assert ends + 1 <= math.ceil(sum(lengths) / 1024) * 1.01


def test_sharding_keeps_groups_and_balances(spark):
    random.seed(3)
    rows = [(i, "t" * random.randint(0, 300) + str(i % 90)) for i in range(900)] + odd_texts()[:-1]
    got = sharding.shard_documents(clashing(documents(spark, rows)), shards=4).collect()
    assert len(got) == len(rows)
    texts = defaultdict(set)
    slots, loads = defaultdict(list), Counter()
    size_of = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == size_of
    for row in got:
        texts[row.text_crc32].add(row.shard)
        slots[row.shard].append(row.slot)
        loads[row.shard] += row["size"]
        assert row.law == "bytes" and row.grown_shard is None
    assert all(len(shards) == 1 for shards in texts.values())
    assert all(sorted(held) == list(range(len(held))) for held in slots.values())


def test_longest_first_is_the_greedy_rule():
    sizes = {f"u{i}": s for i, s in enumerate([7, 7, 6, 5, 4, 4, 3])}
    placed = sharding.longest_first(sizes, 3)
    loads = Counter()
    for unit, shard in placed.items():
        loads[shard] += sizes[unit]
    assert sorted(loads.values()) == [11, 11, 14]  # 7 7 6, 5 on 6, 4 4 on the sevens, 3 on any


def test_shard_sizes_are_near_equal(spark):
    random.seed(8)
    rows = [(i, "é" * random.randint(0, 400)) for i in range(3000)]
    got = sharding.shard_documents(documents(spark, rows)).collect()
    loads = Counter()
    for row in got:
        loads[row.shard] += row["size"]
    assert len(loads) == 40 and max(loads.values()) - min(loads.values()) < 0.02 * max(loads.values())
