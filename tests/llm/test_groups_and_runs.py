"""Operators 11 to 13 against plain versions: clustering, mixing, periodic runs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
import pytest

from odd_documents import clashing, documents, odd_texts
from tachyline.llm import centroids, mixing, periodic_runs

SF = "/root/testdata/sf0.001"

# --- clustering around centroids -----------------------------------------------------------


def plain_clusters(rows, count=16, rounds=3):
    kept = []
    for vec_id, vector in rows:
        if vector is None or len(vector) != 64 or any(x is None or not np.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, [floor(Fraction(x) * 64) for x in vector], [float(x) for x in vector]))
    name = lambda row: (row[0] is None, hashlib.sha256(f"1:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[2])
    middle = [row[1] for row in sorted(kept, key=name)[:count]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(middle)) for _, v, _ in kept]

    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, v, _), (_, i) in zip(kept, assign()):
            groups[i].append(v)
        for i, own in groups.items():
            middle[i] = [sum(column) // len(own) for column in zip(*own)]
    final = assign()
    sums = defaultdict(int)
    for distance, i in final:
        sums[i] += distance
    fits = lambda value: value if value < 1 << 63 else None
    return sorted(
        (
            (vec_id, i, fits(d), fits(sums[i]), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, middle[i])).encode()).hexdigest())
            for (vec_id, _, _), (d, i) in zip(kept, final)
        ),
        key=repr,
    )


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def clusters_of(spark, rows):
    frame = vector_frame(spark, rows).selectExpr("*", "1 AS cluster", "'x' AS cell", "2 AS distance", "3 AS apex")
    return sorted((tuple(r) for r in centroids.clustered(frame).collect()), key=repr)


def test_clusters_equal_a_plain_computation(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r[0], r[1]) for r in table]
    random.seed(3)
    some = [random.gauss(0, 0.3) for _ in range(64)]
    rows += [(None, some), (9001, None), (9002, []), (9003, some[:63]), (9004, [*some[:63], None]), (9005, [*some[:63], float("nan")])]
    rows += [(9006, [*some[:63], float("inf")]), (9007, some), (9007, some), (9007, some[::-1]), (9008, [0.0] * 64), (9009, [-1e-9] * 64)]
    assert clusters_of(spark, rows) == plain_clusters(rows)


def test_few_equal_and_flat_vectors(spark):
    assert clusters_of(spark, []) == []
    assert clusters_of(spark, [(1, [0.5] * 64)]) == plain_clusters([(1, [0.5] * 64)])
    same = [(i, [0.25] * 64) for i in range(40)]
    assert clusters_of(spark, same) == plain_clusters(same)
    flat = [(i, [(i % 7) / 8, (i % 3) / 4] + [0.0] * 62) for i in range(120)]
    assert clusters_of(spark, flat) == plain_clusters(flat)


def test_large_components_stay_exact(spark):
    random.seed(4)
    rows = [(i, [random.uniform(-1, 1) * 10.0 ** random.choice([0, 5, 9]) for _ in range(64)]) for i in range(40)]
    assert clusters_of(spark, rows) == plain_clusters(rows)
    rows.append((100, [1e300, -1e300] + [0.0] * 62))
    got = clusters_of(spark, rows)
    assert got == plain_clusters(rows)
    small = [(i, [random.uniform(-1, 1) for _ in range(64)]) for i in range(40)] + [(2000 + i, [1e300, -1e300] + [0.0] * 62) for i in range(2)]
    assert clusters_of(spark, small) == plain_clusters(small)
    assert any(row[2] is None for row in clusters_of(spark, [(i, [1e300 * (i + 1)] * 64) for i in range(20)]))


def test_the_bounds_hold_the_true_distances_and_leave_centroids_out():
    rng = np.random.default_rng(8)
    middle = rng.integers(-60, 60, (16, 64))
    rows = np.concatenate([middle[rng.integers(0, 16, 400)] + rng.integers(-4, 5, (400, 64)), rng.integers(-60, 60, (100, 64))])
    simplex = centroids.Simplex(middle)
    apexes, over = simplex.apexes(rows), simplex.apexes(middle + 1)
    true = ((rows[:, None] - (middle + 1)[None]) ** 2).sum(2)
    flat = ((apexes[:, None, :-1] - over[None, :, :-1]) ** 2).sum(2)
    low, high = flat + (apexes[:, -1:] - over[:, -1]) ** 2, flat + (apexes[:, -1:] + over[:, -1]) ** 2
    slack = simplex.slack((rows**2).sum(1) + ((middle + 1) ** 2).sum(1).max())[:, None]
    assert (low <= true + slack).all() and (true <= high + slack).all() and slack.max() < 1
    assert (low <= high.min(1, keepdims=True) + 2 * slack).sum(1)[:400].mean() < 3
    cluster, distance = centroids.nearest(rows, apexes, middle + 1, simplex)
    assert (cluster == true.argmin(1)).all() and (distance == true.min(1)).all()


# --- mixing --------------------------------------------------------------------------------


def plain_targets(sizes, limit=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, Fraction(0)), set(names), Fraction(sum(sizes.values()))
    while open_ and left:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if limit * sizes[s] < weight[s] * share}
        if not over:
            return target | {s: weight[s] * share for s in open_}
        for s in over:
            target[s] = Fraction(limit * sizes[s])
        open_, left = open_ - over, left - sum(target[s] for s in over)
    return target


def source_rows():
    random.seed(9)
    rows = []
    for i in range(900):
        source = random.choice(["a", "a", "a", "a", "b", "c", "é", "z", None, "\U0001f600", "｡"])
        rows.append((i % 850, " ".join("w" for _ in range(random.randint(0, 40))), "en", source, 0))
    rows += [(2000, "tiny", "en", "tiny", 0), (2001, None, "en", "void", 0), (2002, "", "en", "void", 0), (None, "a b", "en", None, 0)]
    rows += [(3000, "x " * 60_000, "en", "long", 0), (3001, "one\ttwo\r\nthree four\x0bfive\x1f", "en", "b", 0)]
    return rows + rows[:5]


def test_the_mix_meets_its_targets(spark):
    rows = source_rows()
    frame = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    got = mixing.mixed(frame).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    expected, taken = plain_targets(sizes), defaultdict(int)
    ranges = defaultdict(list)
    for row in got:
        assert row.source_size == sizes[row.source]
        assert row.target == pytest.approx(float(expected[row.source]), rel=1e-12)
        words = sum(s.end - s.first for s in row.slices)
        assert words <= 3 * row.size and all(0 <= s.first < s.end <= row["size"] for s in row.slices)
        taken[row.source] += words
        for s in row.slices:
            ranges[row.source, s.shard].append(s.end - s.first)
    for source, target in expected.items():
        assert abs(taken[source] - target) <= max(1, min(t for t in expected.values() if t) / 100)
    for shard in range(mixing.SHARDS):  # every shard has its share of every source
        for source, target in expected.items():
            assert abs(sum(ranges[source, shard]) - target / mixing.SHARDS) <= max(1, min(t for t in expected.values() if t) / 100)


def test_the_quotas_are_those_of_the_highest_quotients(spark):
    sizes = {"a": 5000, "b": 1200, "c": 7000, "d": 900, "e": 40_000}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    plan = {r["source"]: r for r in mixing.quotas(mixing.targets(frame), block=10, shards=4).collect()}
    for j in range(1, 5):
        seats = {s: r["bounds"][j] // 10 for s, r in plan.items()}
        quotients = sorted(((r["target"] / (2 * k - 1), s) for s, r in plan.items() for k in range(1, 6000)), reverse=True)
        chosen = defaultdict(int)
        for _, s in quotients[: sum(seats.values())]:
            chosen[s] += 1
        assert dict(chosen) == {s: n for s, n in seats.items() if n}


def test_mixing_repeats_itself_and_takes_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert mixing.digests(spark.createDataFrame([], schema)).isEmpty()
    rows = source_rows()
    runs = [
        sorted(map(tuple, mixing.digests(spark.createDataFrame(own, schema).repartition(n)).collect()), key=repr)
        for own, n in ((rows, 1), (rows[::-1], 7))
    ]
    assert runs[0] == runs[1]
    none = mixing.digests(spark.createDataFrame([(1, None, "en", "s", 0), (2, " ", "en", None, 0)], schema)).collect()
    assert sorted(map(tuple, none)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


# --- periodic runs -------------------------------------------------------------------------


def plain_runs(words):
    """Every lag, every stretch; a stretch counts with its smallest period."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(),
    )


def repetitive(seed, count):
    random.seed(seed)
    for _ in range(count):
        words = []
        for _ in range(random.randint(0, 7)):
            letters = "abcdefghijklmnopqrstuvwxyz"[: random.choice([1, 2, 3, 5, 20])]
            unit = random.choices(letters, k=random.randint(1, 15))
            words += unit * random.randint(1, 9) + unit[: random.randint(0, len(unit))] + random.choices("xyz", k=random.randint(0, 3))
        yield words


def test_runs_equal_every_lag_tried():
    texts = list(repetitive(5, 1500)) + [["a"] * n for n in (23, 24, 25)] + [list("abcdefgh") * 3, list("abcdefgh") * 3 + ["a"]]
    texts += [(["a"] * 9 + ["b"]) * 7, list("aabb") * 6 + list("aab"), (list("ab") * 15 + ["c"]) * 4]
    for at in range(0, len(texts), 3):
        some = texts[at : at + 3]
        words, bounds = periodic_runs.words_of(pa.array([" ".join(each) for each in some]))
        got = periodic_runs.runs_in(words.dictionary_encode().indices.to_numpy().astype(np.int64), bounds)
        expected = [(s + int(bounds[i]), n, q) for i, each in enumerate(some) for s, n, q in plain_runs(each)]
        assert [tuple(row) for row in got.tolist()] == sorted(expected, key=lambda r: (r[0], r[2]))


def test_long_segments_that_lose_little_are_scanned_all_the_same(monkeypatch):
    monkeypatch.setattr(periodic_runs, "LONG_SEGMENT", 30)
    monkeypatch.setattr(periodic_runs, "LEAST_LOSS", 2)
    test_runs_equal_every_lag_tried()


def test_a_rare_word_splits_until_nothing_is_rare():
    codes = np.array([0, 1] * 20 + [9] + [0, 2] * 20 + [8, 7] + [3] * 30)
    starts, ends = periodic_runs.segments(codes, np.array([0]), np.array([len(codes)]))
    assert list(zip(starts, ends)) == [(0, 40), (41, 81), (83, 113)]


def test_periodic_runs_of_documents_equal_a_plain_computation(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = table + [(10_000 + i, t) for i, (_, t) in enumerate(odd_texts()) if len(t or "") < 10_000]
    rows += [(20_000 + i, " ".join(words)) for i, words in enumerate(repetitive(6, 300))]
    rows += [(None, "a " * 50), (None, None), (30_000, "x y\x1fz " * 40), (30_000, "\tlead\x0b" * 30), (30_000, "\tlead\x0b" * 30)]
    got = sorted((tuple(r) for r in periodic_runs.digests(clashing(documents(spark, rows))).collect()), key=repr)
    assert got == sorted((plain_row(*row) for row in rows), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 20
    assert periodic_runs.digests(documents(spark, [])).isEmpty()


def test_a_very_long_text_with_a_long_period(spark):
    unit = [f"w{i}" for i in range(50_000)]
    rows = [(1, " ".join(unit * 4)), (2, " ".join(unit[:30_000] * 2)), (3, "same " * 300_000)]
    got = {r.doc_id: r for r in periodic_runs.collapsed(documents(spark, rows)).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 200_000, 50_000)] and got[1].collapsed == " ".join(unit)
    assert got[2].runs == [] and got[2].n_words == 60_000
    assert [tuple(r) for r in got[3].runs] == [(0, 300_000, 1)] and got[3].collapsed == "same"
