"""The pipeline, stage by stage, against brute force on a small table."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from dockflow.llm.host_rules import judge_documents
from dockflow.llm.word_encoder import WordEncoder
from tests.llm.test_line_quality import sample
from tests.llm.test_rules import measures
from tests.llm.test_shingle_join import brute


def good(i):
    return (i - 1 if i % 7 == 3 else i) % 6 > 0


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rng = random.Random(12)
    rows = []
    for i in range(240):
        text = sample(rng, good(i))
        if i % 7 == 3:  # a copy of the text before
            text = rows[-1][1].replace("\n", " \n")
        rows.append((i, text, rng.choice(["en", "fr", "de", None]), f"src{rng.randrange(4)}", len(text)))
    rows += [(900, None, "en", "src1", 0), (901, "", None, None, 0), (902, "short one", "en", "src1", 9), (None, sample(rng, True), "en", "src2", 3)]
    rows += [rows[1], rows[1], (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(good(i)), 0) for i in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def rows_of(df):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect())


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns

    passed = cp.good_documents(spark, docs, tables)
    assert passed.columns == columns and not rows_of(passed) - rows_of(docs)
    ids = {r["doc_id"] for r in passed.collect()} & set(range(240))
    assert sum((i in ids) == good(i) for i in range(240)) >= 235

    ruled = cp.by_host_rules(spark, docs, tables)
    assert ruled.columns == columns
    want = Counter()
    verdicts = {(r["doc_id"], r["n_words"]): r["kept"] for r in judge_documents(docs).collect()}
    for row, n in rows_of(docs).items():
        if verdicts[row[0], measures(row[1])[0]]:
            want[row] = n
    assert rows_of(ruled) == want and 0 < len(want) < 246

    unique = cp.without_near_duplicates(spark, docs, tables)
    assert unique.columns == columns
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    heads = {(c[3]) for c in brute(plain) if c[2] > 0}
    kept = Counter(r["doc_id"] for r in unique.collect())
    empty = Counter(r[0] for r in plain if not measures(r[1])[0])
    assert kept == Counter(heads) + empty

    mixed = cp.mixed(spark, docs, tables)
    assert mixed.columns == columns and set(rows_of(mixed)) <= set(rows_of(docs))
    words = sum(measures(t)[0] for _, t in plain)
    assert 0.8 * words / 2 < sum(measures(r["text"])[0] for r in mixed.collect()) <= words / 2

    library = WordEncoder.from_file(cp.vocabulary()).tokenizer
    coded = {r["doc_id"]: r for r in cp.token_ids(spark, docs, tables).collect()}
    for doc_id, text in plain:
        if doc_id is not None:
            made = library.encode(text or "", add_special_tokens=False).ids
            row = coded[doc_id]
            assert np.frombuffer(row["ids"], dtype="<u4").tolist() == made and row["n_tokens"] == len(made)
            decoded = library.decode(made, skip_special_tokens=False)
            assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_run(spark, tables):
    out = cp.run(spark, tables)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() > 20
    assert [name for name, _ in cp.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "mixing", "bpe"]


def test_empty_tables_and_clashing_columns(spark, tables, tmp_path):
    """No documents give no rows at any stage; columns named like the operators' own are carried along."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    clash = docs.selectExpr("*", "1 AS id", "'x' AS k", "2.5D AS score", "3 AS n", "'d' AS domain", "'r' AS `row`", "4 AS epochs")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, clash, tables)
        assert out.columns == clash.columns
        assert out.where("id <> 1 OR k <> 'x' OR score <> 2.5D OR n <> 3 OR domain <> 'd' OR `row` <> 'r' OR epochs <> 4").count() == 0
        assert out.count() > 20
    assert cp.token_ids(spark, clash, tables).count() == docs.count()
