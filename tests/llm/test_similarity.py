"""The Jaccard join and the line dedup against comparisons of all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_documents import clashing, documents, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st

from tachyline.llm import components, hashing, jaccard_join, line_dedup
from tachyline.llm.batches import whole_runs
from tachyline.llm.key_filter import KeyFilter


class Groups:
    def __init__(self, items):
        self.above = {item: item for item in items}

    def find(self, item):
        while self.above[item] != item:
            item = self.above[item]
        return item

    def join(self, a, b):
        self.above[self.find(a)] = self.find(b)


def plain_shingles(text, width=4):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", small)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1)))


def plain_groups(rows, width=4, percent=85):
    sets = [plain_shingles(text, width) for _, text in rows]
    groups = Groups(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                groups.join(i, j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[groups.find(i)].append(doc_id)
    return [
        (doc_id, len(sets[i]), min((x for x in ids[groups.find(i)] if x is not None), default=None))
        for i, (doc_id, _) in enumerate(rows)
    ]


def edited(words, edits):
    words = list(words)
    for _ in range(edits):
        at = random.randrange(len(words))
        words[at] = f"e{random.random()}"
    return words


def near_copies(count=260):
    random.seed(21)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = random.choices(vocabulary, k=40)
    rows = []
    for g in range(count // 10):
        base = random.choices(vocabulary, k=random.choice([3, 5, 30, 120, 300]))
        for _ in range(random.choice([1, 2, 3, 6])):
            rows.append(" ".join(edited(base, random.randint(0, 6))))
    base = random.choices(vocabulary, k=150)
    rows += [" ".join(edited(base, random.choice([0, 0, 1, 2, 3, 5, 9, 20]))) for _ in range(count // 4)]
    for _ in range(count // 4):
        own = random.choices(vocabulary, k=random.randint(30, 200))
        rows.append(" ".join(own[:20] + passage + own[20:]))
    for _ in range(count // 8):
        rows.append(" ".join(base[: random.randint(100, 150)]))
    random.shuffle(rows)
    return [(i, text) for i, text in enumerate(rows)] + [(1000 + i, t) for i, (_, t) in enumerate(odd_texts())]


@pytest.mark.parametrize("most", [4096, 24])
def test_join_equals_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "MOST_IN_TASK", most)
    rows = near_copies()
    got = jaccard_join.digests(clashing(documents(spark, rows))).collect()
    assert Counter(map(tuple, got)) == Counter(plain_groups(rows))


@pytest.mark.parametrize("short, frequent, held", [(2, 2000, 1 << 17), (16, 10, 50), (40, 10**9, 1 << 17)])
def test_join_does_not_depend_on_how_lists_are_kept(spark, monkeypatch, short, frequent, held):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "whole_runs", lambda b, k, most_held=held: whole_runs(b, k, most_held))
    rows = near_copies(120)
    got = jaccard_join.digests(documents(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_groups(rows))


def test_join_of_random_small_sets(spark):
    random.seed(33)
    rows = [(i, " ".join(random.choices("abc", k=random.randint(0, 12)))) for i in range(500)]
    got = jaccard_join.digests(documents(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_groups(rows))


def test_nulls_repeats_and_empty_tables(spark):
    rows = odd_texts() + [(None, "a b c d e f"), (None, "same text here now"), (None, "same text here now")]
    got = jaccard_join.digests(documents(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_groups(rows))
    assert jaccard_join.digests(documents(spark, [])).isEmpty()
    assert jaccard_join.digests(documents(spark, [(1, None), (2, "")])).count() == 2


def test_one_document_of_each_group_stays(spark):
    rows = near_copies(120)
    groups = plain_groups(rows)
    kept = jaccard_join.one_of_each_group(documents(spark, rows + [(7, rows[7][1])]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    expected = sorted(
        doc_id for (doc_id, n, component) in groups if not n or doc_id == component
    )
    assert sorted(r.doc_id for r in kept.collect()) == expected


def test_the_join_lists_no_pairs_of_a_large_group(spark):
    """1,500 near copies: what is handed on stays near their number."""
    random.seed(2)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(base, random.randint(0, 2)))) for i in range(1500)]
    docs, rule = documents(spark, rows), jaccard_join.Rule()
    signed = jaccard_join.signatures(docs, rule)
    order = jaccard_join.Order(*jaccard_join.frequent_shingles(signed.filter("token is not null"), 1500))
    found = jaccard_join.candidates(jaccard_join.prefix_postings(docs, rule, order), rule)
    clustered = jaccard_join.clusters(found, rule)
    assert clustered.count() < 30 * 1500
    assert jaccard_join.digests(docs).select("component_id").distinct().count() <= 3


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=25))
def test_union_find(pairs):
    sets, groups = components.Sets(15), Groups(range(15))
    for a, b in pairs:
        sets.join(a, b)
        groups.join(a, b)
    for a in range(15):
        for b in range(15):
            assert (sets.root(a) == sets.root(b)) == (groups.find(a) == groups.find(b))
        assert sets.root(a) <= a


def test_components_of_chains_stars_and_negative_nodes(spark):
    random.seed(1)
    nodes = random.sample(range(-(10**6), 10**6), 400)
    pairs = list(zip(nodes[:150], nodes[1:151])) + [(nodes[200], n) for n in nodes[201:300]] + [(nodes[0], nodes[0])]
    pairs += [tuple(random.sample(nodes[300:], 2)) for _ in range(40)]
    groups = Groups(nodes)
    for a, b in pairs:
        groups.join(a, b)
    least = {}
    for node in nodes:
        least[groups.find(node)] = min(node, least.get(groups.find(node), node))
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    for node in {n for pair in pairs for n in pair}:
        assert got.get(node, node) == least[groups.find(node)]
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_key_filter_lets_all_wanted_through(spark):
    random.seed(6)
    keys = [random.randrange(-(1 << 63), 1 << 63) for _ in range(500)] + [0, -1, (1 << 63) - 1]
    wanted = KeyFilter(spark.createDataFrame([(k,) for k in keys] + [(None,)], "key long"), "key")
    assert wanted.passing(np.array(keys)).all()
    others = np.array([random.randrange(-(1 << 63), 1 << 63) for _ in range(2000)])
    assert wanted.passing(others).mean() < 0.01


SF = "/root/testdata/sf0.001"

# --- line dedup ----------------------------------------------------------------------------


def plain_line_words(line):
    return [w for w in re.split("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", line.translate(
        {c: c + 32 for c in range(65, 91)})) if w]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def plain_simhash(words):
    """Majority of each bit over the words' hashes, under each lane's seed."""
    seen, hashes, out = Counter(), [], []
    for w in words:
        (h,) = hashing.words_of([w.encode()], hashing.ALPHANUMERIC).hashes
        hashes.append((int(h) + seen[w] * int(line_dedup._AGAIN)) % 2**64)
        seen[w] += 1
    for seed in hashing.mixed(np.arange(1, line_dedup.LANES + 1, dtype=np.uint64)):
        own = [h * (int(seed) | 1) % 2**64 for h in hashes]
        own = [h ^ h >> 32 for h in own]
        out.append(sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in own) > len(own)))
    return tuple(out)


def plain_candidates(classes):
    """Pairs of a cluster: chains of meetings in a bucket (one block alike, lengths that allow it, few checked bits
    apart), those with the same least key together."""
    keys, clusters = {}, defaultdict(set)
    for words in classes:
        hashes = hashing.words_of([" ".join(words).encode()], hashing.ALPHANUMERIC, apart=True).hashes
        keys[words] = int(hashing.run_hashes(hashes, np.array([0]), np.array([len(hashes)])).view(np.int64)[0])
    for number in range(line_dedup.BLOCKS):
        buckets = defaultdict(list)
        for words, simhash in classes.items():
            buckets[simhash[number // 4] >> 16 * (number % 4) & 0xFFFF].append(words)
        for members in buckets.values():
            chain = Groups(members)
            for x, a in enumerate(members):
                for b in members[:x]:
                    apart = sum((i ^ j).bit_count() for i, j in zip(classes[a][-2:], classes[b][-2:]))
                    alone = [n for n in map(len, (a, b)) if int(n / 5 + 1e-9) == 0 and int((n + 1) / 5 + 1e-9) == 0]
                    if not alone and apart <= line_dedup.MOST_BITS and 0.8 * max(len(a), len(b)) <= min(len(a), len(b)) + 1e-9:
                        chain.join(a, b)
            held = defaultdict(set)
            for a in members:
                held[chain.find(a)].add(a)
            for own in held.values():
                clusters[min(keys[a] for a in own)] |= own
    return {frozenset((a, b)) for own in clusters.values() for a in own for b in own if a != b}


def plain_dedup(rows):
    classes, places = {}, defaultdict(list)
    for n, (doc_id, text) in enumerate(rows):
        for i, line in enumerate((text or "").split("\n")):
            words = tuple(plain_line_words(line))
            if len(words) >= line_dedup.MIN_WORDS:
                classes.setdefault(words, plain_simhash(words))
                places[words].append(((doc_id is None, doc_id or 0), n, i))
    groups, keys = Groups(classes), list(classes)
    for pair in plain_candidates(classes):
        a, b = pair if len(pair) == 2 else (*pair, *pair)
        if 1 - plain_distance(a, b) / max(len(a), len(b)) >= line_dedup.SIMILARITY - 1e-9:
            groups.join(a, b)
    held = defaultdict(list)
    for words in keys:
        held[groups.find(words)] += places[words]
    cut = defaultdict(set)
    for found in held.values():
        first = min((doc, i) for doc, _, i in found)
        for doc, n, i in found:
            if (doc, i) != first:
                cut[n].add(i)
    out = []
    for n, (doc_id, text) in enumerate(rows):
        lines = (text or "").split("\n")
        left = None if text is None else "\n".join(line for i, line in enumerate(lines) if i not in cut[n])
        out.append((doc_id, left, 0 if text is None else len(lines), len(cut[n])))
    return out


def line_rows():
    random.seed(44)
    vocabulary = [f"v{i}" for i in range(900)] + ["É", "don't"]
    passages = [random.choices(vocabulary, k=random.choice([6, 20, 60, 90])) for _ in range(12)]
    rows = []
    for i in range(80):
        lines = [" ".join(random.choices(vocabulary, k=random.randint(0, 25))) for _ in range(random.randint(0, 6))]
        for passage in random.sample(passages, 3):
            copy = edited(passage, random.choice([0, 0, 0, 1, 2]))
            lines.insert(random.randint(0, len(lines)), ", ".join(copy).upper() if random.random() < 0.3 else " ".join(copy))
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "one two three four\none two three four"), (204, rows[5][1])]
    return rows


def test_line_dedup_equals_all_pairs(spark):
    rows = line_rows()
    got = line_dedup.deduplicated(clashing(documents(spark, rows))).collect()
    plain = plain_dedup(rows)
    assert sum(cut for *_, cut in plain) > 100
    assert Counter(map(tuple, got)) == Counter(plain)


def test_fuzzy_lines_are_found(spark):
    """Copies of long passages with a word changed, which no exact comparison would find."""
    random.seed(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    bases = [random.choices(vocabulary, k=120) for _ in range(60)]
    rows = [(2 * i + k, " ".join(edited(base, k))) for i, base in enumerate(bases) for k in range(2)]
    got = line_dedup.deduplicated(documents(spark, rows)).collect()
    assert sum(r.n_cut for r in got) == 60
    assert all(r.doc_id % 2 for r in got if r.n_cut)


def test_line_dedup_of_odd_documents(spark):
    rows = odd_texts()
    got = line_dedup.deduplicated(clashing(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert [r.n_cut for r in got if r.doc_id == 6] == [1, 1]
    assert line_dedup.deduplicated(documents(spark, [])).isEmpty()


def test_documents_that_only_repeat_go(spark):
    rows = [(1, "alpha beta gamma delta epsilon\nown words of the first one"), (2, "Alpha, beta gamma delta epsilon!"),
            (3, "alpha beta gamma delta epsilon\nshort line"), (4, None), (5, "..."), (1, "something else is in here too")]
    got = line_dedup.clean_documents(documents(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = Counter((r.doc_id, r.text, r.n_chars) for r in got.collect())
    assert texts == Counter([(1, rows[0][1], len(rows[0][1])), (3, "short line", 10), (4, None, 0), (5, "...", 3), (1, rows[5][1], len(rows[5][1]))])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_edit_distance(a, b):
    assert line_dedup.edit_distance(a, b) == plain_distance(a, b)
    longer = max(len(a), len(b), 1)
    assert line_dedup.similar(np.array(a, np.uint64), np.array(b, np.uint64)) == (
        5 * plain_distance(a, b) <= longer
    )


def test_simhashes_equal_plain_majorities():
    random.seed(21)
    lines = [random.choices([f"v{i}" for i in range(50)], k=k) for k in (1, 2, 3, 4, 7, 8, 31, 64, 65, 200)]
    words, _, _, first, last = line_dedup.line_words(["\n".join(" ".join(line) for line in lines).encode()])
    got = line_dedup.simhashes(words.hashes, first, last)
    assert [tuple(map(int, row)) for row in got] == [plain_simhash(line) for line in lines]


def test_many_near_lines_are_handed_on_a_row_each(spark):
    random.seed(3)
    base = random.choices([f"v{i}" for i in range(500)], k=200)
    rows = [(i, " ".join(edited(base, 1))) for i in range(600)]
    classes = line_dedup.occurrences(documents(spark, rows)).filter("n IS NOT NULL")
    found = line_dedup.candidates(line_dedup.postings(classes))
    assert found.count() < 600 * line_dedup.BLOCKS
    got = line_dedup.deduplicated(documents(spark, rows)).collect()
    assert [r.doc_id for r in got if not r.n_cut] == [0]


@pytest.mark.parametrize("length", [20, 27, 40, 60, 100, 400])
def test_recall_at_the_declared_reach(spark, length):
    """Lines of the documents' own words with a twentieth of them replaced, dropped or put in; none with too many linked."""
    random.seed(length)
    table = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    stock = [w for r in table for w in plain_line_words((r.text or "").replace("\n", " "))]
    edits, rows, linked, beyond = int(length * (1 - line_dedup.REACH) + 1e-9), [], set(), set()
    for i in range(240):
        start = random.randrange(len(stock) - length)
        base = stock[start : start + length - 2] + [f"n{i}", f"m{i}"]
        most = edits if i % 4 else length // 4 + 1
        copy = list(base)
        for k, at in enumerate(sorted(random.sample(range(length), most), reverse=True)):
            copy[at : at + 1] = [[f"e{i}x{k}"], [], [copy[at], f"e{i}x{k}"]][i % 3]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        similarity = 1 - plain_distance(base, copy) / max(len(base), len(copy))
        if similarity >= line_dedup.REACH - 1e-9:
            linked.add(2 * i + 1)
        elif similarity < line_dedup.SIMILARITY:
            beyond.add(2 * i + 1)
    got = {r.doc_id for r in line_dedup.deduplicated(documents(spark, rows)).collect() if r.n_cut}
    recall = len(got & linked) / len(linked)
    print(f"{length} words: {recall:.3f} of {len(linked)} found at {line_dedup.REACH}")
    assert len(linked) >= 100 and recall >= line_dedup.RECALL and not got & beyond


def test_a_class_has_one_row_a_block_however_many_tasks_have_seen_it(spark):
    classes = line_dedup.occurrences(documents(spark, [(i, "one two three four five") for i in range(8)]).repartition(4))
    classes = classes.filter("n IS NOT NULL").unionByName(classes.filter("n IS NOT NULL"))
    assert classes.count() > 1
    assert line_dedup.postings(classes).count() == line_dedup.BLOCKS


def test_wide_buckets_and_windows_give_the_same(spark, monkeypatch):
    """Buckets searched line by line, against the comparison of all pairs that meet."""
    monkeypatch.setattr(line_dedup, "WIDE", 2)
    test_line_dedup_equals_all_pairs(spark)


def test_edit_similarity_alone_decides_among_lines_that_meet(spark, monkeypatch):
    """Chains of many lines over few words, against all pairs."""
    random.seed(77)
    vocabulary = [f"v{i}" for i in range(12)]
    bases = [random.choices(vocabulary, k=k) for k in (5, 6, 9, 10, 11, 15, 24)]
    rows = [(i, " ".join(edited(random.choice(bases), random.randint(0, 4)))) for i in range(160)]
    rows += [(200 + i, " ".join(random.choices("ab", k=random.randint(4, 12)))) for i in range(120)]
    meeting = line_dedup.deduplicated(documents(spark, rows)).collect()
    assert Counter(map(tuple, meeting)) == Counter(plain_dedup(rows))


def test_scripts_without_spaces_and_short_lines_take_part(spark):
    """Lines of Chinese, Japanese and Thai, whole and with some characters changed; exact repeats of short lines."""
    lines = ["".join(chr(start + 7 * i % 80) for i in range(60)) for start in (0x4E00, 0x3041, 0x0E01, 0x20000)]
    lines[0] = lines[0][:30] + "，" + lines[0][30:] + "。"
    changed = [line[:9] + line[0] * 6 + line[15:] for line in lines]
    other = ["".join(reversed(line)) for line in lines]
    short = ["one two three", "單", "É a!"]
    rows = [(1, "\n".join(lines + short)), (2, "\n".join(lines + ["One, two three.", "單", "É A"])),
            (3, "\n".join(changed)), (4, "\n".join(other + ["one two four", "...", "..."]))]
    got = {r.doc_id: (r.text, r.n_cut) for r in line_dedup.deduplicated(documents(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("", 7), 3: ("", 4), 4: (rows[3][1], 0)}


def test_characters_of_scripts_without_spaces_are_words():
    text = "ab漢字cd ไทย 𠀀𠀁 한국 l’été"
    words = hashing.words_of([text.encode()], hashing.ALPHANUMERIC, apart=True)
    plain = [hashing.words_of([w.encode()], hashing.ALPHANUMERIC).hashes[0] for w in "ab 漢 字 cd ไ ท ย 𠀀 𠀁 한국 l’été".split()]
    assert words.hashes.tolist() == plain


def test_a_bucket_in_several_parts_is_compared_whole(spark, monkeypatch):
    """Links between the parts of a bucket that is too long to be held at once."""
    monkeypatch.setattr(line_dedup, "whole_runs", lambda b, k, most_held=20: whole_runs(b, k, most_held))
    monkeypatch.setattr(line_dedup, "MOST_IN_TASK", 40)
    conf, name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "16")
    try:
        rows = [(i, f"the same words stand here again and again before a number and behind it {i}") for i in range(300)]
        classes = line_dedup.occurrences(documents(spark, rows)).filter("n IS NOT NULL")
        found = line_dedup.candidates(line_dedup.postings(classes))
        assert found.groupBy("label").count().agg({"count": "max"}).first()[0] >= 200
        got = line_dedup.deduplicated(documents(spark, rows)).collect()
    finally:
        conf.set(name, before)
    assert [r.doc_id for r in got if not r.n_cut] == [0]


def test_a_common_line_is_not_dealt_by_its_key(spark, monkeypatch):
    """Classes above and below the share that is joined by broadcast give the same result; short lines can be left alone."""
    rows = [(i, f"footer of all pages\nOK\nown line number {i} with words of its own {i * i}") for i in range(60)]
    for share in (2, 10_000):
        monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
        got = {r.doc_id: r.n_cut for r in line_dedup.deduplicated(documents(spark, rows)).collect()}
        assert got[0] == 0 and all(got[i] >= 2 for i in range(1, 60))
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(documents(spark, rows), min_words=2).collect()}
    assert all(text.split("\n")[0] == "OK" for i, text in got.items() if i)


def test_simhash_bits_are_majorities():
    """Each bit against a plain count over the words, for runs of any length, repeats included."""
    random = np.random.default_rng(7)
    lengths = [1, 2, 3, 7, 8, 9, 16, 17, 255, 256, 257, 1000, 5000]
    runs = [random.integers(0, 1 << 63, n, np.uint64) for n in lengths]
    runs += [np.repeat(run[:1], 5) for run in runs[:2]] + [np.tile(runs[3], 40)]
    last = np.cumsum([len(run) for run in runs])
    first = last - [len(run) for run in runs]
    got = line_dedup.simhashes(np.concatenate(runs), first, last)
    seeds = line_dedup.mixed(np.arange(1, line_dedup.LANES + 1, dtype=np.uint64)) | np.uint64(1)
    mask = (1 << 64) - 1
    for run, bits in zip(runs, got):
        met: dict[int, int] = {}
        counts = [[0] * 64 for _ in seeds]
        for word in run.tolist():
            rank = met.get(word, 0)
            met[word] = rank + 1
            for lane, seed in enumerate(seeds.tolist()):
                value = (word + rank * int(line_dedup._AGAIN)) * seed & mask
                value ^= value >> 32
                counts[lane] = [count + (value >> bit & 1) for bit, count in enumerate(counts[lane])]
        plain = [sum((2 * count > len(run)) << bit for bit, count in enumerate(lane)) for lane in counts]
        assert bits.tolist() == plain
    assert line_dedup.simhashes(runs[0], first[:0], last[:0]).shape == (0, line_dedup.LANES)


def test_postings_are_packed_and_tie_the_lines_that_meet(spark, monkeypatch):
    """21 bytes a posting, many in a row; chains of all pairs of a bucket, counted plainly, also in ranges of few buckets."""
    random.seed(33)
    bases = [random.choices([f"v{i}" for i in range(300)], k=random.randint(4, 40)) for _ in range(300)]
    lines = [" ".join(edited(base, k)) for base in bases for k in range(4)]
    lines += [" ".join(random.sample(line.split(), len(line.split()))) for line in lines[:40]]  # the same bits
    classes = line_dedup.occurrences(documents(spark, list(enumerate(lines)))).filter("n >= 4").dropDuplicates(["key"])
    classes = line_dedup.stored(classes, "classes")
    rows = [(r.key, r.n, [r[f"lane{lane}"] % (1 << 64) for lane in range(line_dedup.LANES)]) for r in classes.collect()]
    buckets: dict = {}
    for at, (_, _, lanes) in enumerate(rows):
        for number in range(line_dedup.BLOCKS):
            buckets.setdefault((number, lanes[number // 4] >> 16 * (number % 4) & 0xFFFF), []).append(at)
    chains = set()
    for own in buckets.values():
        above = {at: at for at in own}
        for x in own:
            for y in own:
                bits = sum((rows[x][2][lane] ^ rows[y][2][lane]).bit_count() for lane in (-2, -1))
                shorter, longer = sorted((rows[x][1], rows[y][1]))
                if bits <= line_dedup.MOST_BITS and 5 * shorter >= 4 * longer and above[x] != above[y]:
                    old, now = above[x], above[y]
                    above = {at: now if root == old else root for at, root in above.items()}
        chain: dict = {}
        for at, root in above.items():
            chain.setdefault(root, set()).add(rows[at][0])
        chains |= {frozenset(keys) for keys in chain.values() if len(keys) > 1}
    expected = {(min(keys), key) for keys in chains for key in keys}
    for most in (line_dedup.IN_RANGE, 10):
        monkeypatch.setattr(line_dedup, "IN_RANGE", most)
        packed = line_dedup.stored(line_dedup.postings(classes), "postings")
        sizes = [sum(len(r[name]) for name in ("bits", "low", "high", "first", "second")) for r in packed.collect()]
        assert sum(sizes) == 21 * len(rows) * line_dedup.BLOCKS
        assert len(sizes) < len(rows) * (1 if most > 10 else line_dedup.BLOCKS)
        got = line_dedup.clusters(line_dedup.candidates(packed), classes).collect()
        assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_most_lines_with_a_tenth_of_their_words_replaced_share_a_block():
    random.seed(90)
    lines = [[f"a{random.randrange(10**9)}" for _ in range(60)] for _ in range(400)]
    copies = [[f"b{i}" if i % 10 == k % 10 else word for i, word in enumerate(line)] for k, line in enumerate(lines)]
    words, _, _, first, last = line_dedup.line_words(["\n".join(map(" ".join, lines + copies)).encode()])
    blocks = line_dedup.simhashes(words.hashes, first, last).view(np.uint16)
    assert blocks.shape[1] == line_dedup.BLOCKS
    assert (blocks[:400] == blocks[400:]).any(1).mean() > 0.85
