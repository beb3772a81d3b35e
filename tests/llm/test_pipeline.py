"""The pipeline's stages against plain versions of what each decides."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from odd_documents import clashing, documents, odd_texts
from pyspark.sql import functions as F
from test_documents import plain_contamination
from test_similarity import plain_dedup, plain_groups
from test_tokens import check_packing

import corpus_pipeline
from tachyline.llm.common import stored

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = stored(stage(spark, docs, SF), "stage")
        out.append((name, docs.collect(), result.collect(), result.columns))
        docs = result
    return out


def test_documents_without_a_language_go(stages):
    _, before, after, columns = stages[0]
    assert columns == COLUMNS
    assert Counter(after) == Counter(r for r in before if re.search(r"[^\W\d_]", r.text or ""))


def test_repeated_lines_go(stages):
    _, before, after, columns = stages[1]
    assert columns == COLUMNS
    plain = plain_dedup([(r.doc_id, r.text) for r in before])
    expected = Counter((i, text) for i, text, _, cut in plain if not cut or re.search("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", text))
    assert Counter((r.doc_id, r.text) for r in after) == expected
    assert all(r.n_chars == len(r.text) for r in after if r.doc_id in {i for i, _, _, cut in plain if cut})


def test_one_of_each_group_stays(stages):
    _, before, after, columns = stages[2]
    assert columns == COLUMNS
    groups = plain_groups([(r.doc_id, r.text) for r in before], width=5, percent=80)
    kept = {doc_id for doc_id, n, component in groups if not n or doc_id == component}
    assert Counter(after) == Counter(r for r in before if r.doc_id in kept)


def test_contaminated_documents_go(spark, stages):
    _, before, after, columns = stages[3]
    assert columns == COLUMNS
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    judged = plain_contamination([(r.doc_id, r.text) for r in before], items)
    assert Counter(after) == Counter(r for r, row in zip(before, judged) if not row[5])


def test_the_rest_is_packed(stages):
    _, before, after, _ = stages[4]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    check_packing([r.asDict() for r in after], 1024)


def test_run_is_the_stages_in_order(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert Counter(got) == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in stages[4][2])


def test_odd_documents_pass_the_stages(spark):
    docs = documents(spark, odd_texts())
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
    assert not docs.isEmpty()
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
    assert docs.isEmpty()


def test_columns_with_clashing_names_pass_the_stages(spark):
    """Names that stages use inside, as columns of the documents: kept as they are by all but the last."""
    docs = clashing(documents(spark, odd_texts()))
    for name in ("root", "first", "key", "n", "line", "lines", "place", "maybe", "row", "label", "simhash", "in0", "text_key", "first_", "all"):
        docs = docs.withColumn(name, F.lit("y"))
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "stage")
        assert docs.columns == names
    assert {tuple(r) for r in docs.select("root", "line", "size").distinct().collect()} == {("y", "y", "x")}
    assert not corpus_pipeline.STAGES[-1][1](spark, docs, SF).isEmpty()


def test_near_copies_are_those_of_five_words_and_eighty_percent(spark):
    """Against a comparison of all pairs; some are near copies by this rule but not by op6's."""
    random.seed(12)
    rows, vocabulary = [], [f"v{i}" for i in range(3000)]
    for i in range(40):
        base = random.choices(vocabulary, k=400)
        copy = [f"e{i}x{k}" if k % 40 == 5 and k < 40 * (5 + i % 7) else w for k, w in enumerate(base)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:335] if i % 10 == 9 else copy))]

    def similarity(a, b, width):
        sets = [{tuple(t.split()[k : k + width]) for k in range(len(t.split()) - width + 1)} for t in (a, b)]
        return len(sets[0] & sets[1]) / len(sets[0] | sets[1])

    pairs = list(zip(rows[::2], rows[1::2]))
    gone = {b[0] for a, b in pairs if similarity(a[1], b[1], 5) >= 0.8}
    assert any(similarity(a[1], b[1], 4) < 0.85 for a, b in pairs if b[0] in gone) and len(gone) < len(pairs)
    kept = corpus_pipeline.join_near_copies(spark, documents(spark, rows), SF)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - gone
