"""Language by compression and the archive round trip."""

import hashlib
import os
import pickle
import random
import subprocess
import sys
import unicodedata

import pytest
import zstandard
from pyspark.sql import functions as F

from dockflow.llm.language_id import Languages, learn_languages, predict_languages
from dockflow.llm.warc import parse_record, read_archive, read_warc, record_bytes, write_warc

SYLLABLES = {"en": "the and ing tion er th re".split(), "es": "os ción ado que ñi llo ez".split(), "de": "sch ung keit der ich pf".split()}


def prose(lang, rng, n=60):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_copies_do_not_starve_a_dictionary(spark):
    rng = random.Random(7)
    rows = [(prose("en", rng, 5), "en") for _ in range(300)] + [(prose("de", rng, 5), "de") for _ in range(50)]
    df = spark.createDataFrame(rows, "text string, lang string")
    copies = spark.range(30_000).select(F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    languages = learn_languages(df.unionByName(copies), F.lit(True), sample_texts=8)
    assert languages.names == ["en", "de"]
    assert [content.count(b"\n") + 1 for _, content in languages.dictionaries] == [8, 8]


def test_languages_are_told_apart(spark):
    rng = random.Random(1)
    rows = [(i, prose(lang, rng), lang) for i, lang in enumerate(["en"] * 60 + ["es"] * 40 + ["de"] * 30)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "en"), (1003, "xx", None), (None, prose("de", rng), "de")] * 2
    rows.append((2000, prose("es", rng, 20_000), None))
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    languages = learn_languages(df, F.col("doc_id").isNull() | (F.col("doc_id") % 2 == 0), sample_texts=8)
    assert languages.names == ["en", "es", "de"]
    out = predict_languages(df, languages).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    kinds = {r["doc_id"]: r for r in out}
    right = sum(kinds[i]["lang_pred"] == lang for i, _, lang in rows[:130])
    assert right >= 128 and kinds[2000]["lang_pred"] == "es" and kinds[None]["lang_pred"] == "de"
    assert {kinds[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and kinds[1002]["rejected"]
    assert predict_languages(df.limit(0), languages).count() == 0
    none = learn_languages(df, F.lit(False))
    assert {r["lang_pred"] for r in predict_languages(df, none).collect()} == {"und"}


def test_predictions_by_plain_compression(spark):
    """Every whole text compressed anew with each dictionary, with nothing of the operator but its dictionaries."""
    rng = random.Random(11)
    rows = [(i, prose(rng.choice(sorted(SYLLABLES)), rng, rng.choice([1, 3, 30, 3_000])), rng.choice(sorted(SYLLABLES))) for i in range(90)]
    rows += [(100, "½ ² ①", "en"), (101, "½ ² ① é", "de"), (102, "日本語", "en"), (103, "ª", "en"), (104, "_ 12", "de"), (105, "\u0345", "es")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages = learn_languages(df, F.lit(True), sample_texts=6, sample_bytes=200)
    got = {r["doc_id"]: r for r in predict_languages(df, languages).collect()}
    for i, text, _ in rows:
        if not any(unicodedata.category(c).startswith("L") for c in text):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0), text
            continue
        data, sizes = text.lower().encode(), []
        for _, content in languages.dictionaries:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            total = 0
            for at in range(0, len(data), 4096):
                # a fresh compressor for every piece
                tool = zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False)
                total += len(tool.compress(data[at : at + 4096]))
            sizes.append(total)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        assert got[i]["lang_pred"] == languages.names[best]
        assert got[i]["score"] == pytest.approx(1 / sum(2.0 ** ((sizes[best] - s) / 8) for s in sizes))
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {100, 104, 105}


def test_dictionaries_come_from_anywhere_in_a_text(spark):
    texts = [f"{'a' * 5000}{i:05}{'b' * 5000}" for i in range(40)]
    df = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    content = learn_languages(df, F.lit(True), sample_texts=40, sample_bytes=100).dictionaries[0][1]
    assert 0.2 < content.count(b"b") / len(content) < 0.8


def test_tools_work_where_the_package_is_missing(spark, tmp_path):
    import public_tokenizers

    from dockflow.llm.shared import shipped
    from dockflow.llm.word_encoder import WordEncoder

    tools = [Languages([("a", b"abc" * 50)]), WordEncoder.from_file(public_tokenizers.path("word_bpe_49k.json"))]
    (tmp_path / "tools").write_bytes(pickle.dumps([shipped(spark, t).value for t in tools]))
    code = (
        "import pickle, importlib.util\nfrom pyspark import cloudpickle\nassert importlib.util.find_spec('dockflow') is None\n"
        "a, b = map(cloudpickle.loads, pickle.load(open('tools', 'rb')))\nprint(len(a.sizes('abc')), len(b.encode_texts(['some words'])[0]) // 4)"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["1", "2"], done.stderr


def test_sizes_cover_the_whole_text():
    tool = Languages([("a", b"abc" * 50)])
    noise = "".join(random.Random(0).choices("abcdefghij", k=20_000))
    assert tool.sizes(noise)[0] > 2 * tool.sizes(noise[:8_000])[0]


def pages():
    big, other = "<p>x</p>" * 200, "é" * 600
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (None, "http://n", big), (7, "u\r\nv ü", other)]
    rows += [(8, "", None), (9, "http://e", ""), (10, "http://s", "small"), (11, "http://s", "small"), (5, "http://a/5", big)]
    rows += [(100 + i, f"http://r/{i}", f"page {i} " * 300) for i in range(40)] + [(999, "http://long", "long text " * 300_000)]
    return rows


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x") for r in pages()], "page_id long, url string, html string, payload_bytes string")
    folder = str(tmp_path / "warc")
    write_warc(df.repartition(3), folder)
    got = read_warc(spark, folder).collect()
    assert len(got) == len(pages())
    kinds = {(r["page_id"], r["url"]): r for r in got}
    for page_id, _, html in pages():
        r = next(x for k, x in kinds.items() if k[0] == page_id)
        payload = (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == payload
    types = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert types[5] == ("response", None) and types[1] == types[3] == types[None] == ("revisit", 5)
    assert types[10] == types[11] == types[8] == types[9] == types[7] == ("response", None)
    for file in (tmp_path / "warc").glob("part-*"):
        data = file.read_bytes()
        assert data[:4] == b"\x5d\x2a\x4d\x18"
        known = zstandard.ZstdCompressionDict(data[8 : 8 + int.from_bytes(data[4:8], "little")])
        whole = zstandard.ZstdDecompressor(dict_data=known).stream_reader(data, read_across_frames=True).read()
        assert whole.count(b"WARC/1.1\r\n") == sum(1 for _ in read_archive(data))


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    write_warc(df, str(tmp_path / "none"))
    assert read_warc(spark, str(tmp_path / "none")).count() == 0


def test_damage_is_found():
    record = record_bytes(1, "http://a", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert parse_record(record)[0] == 1
    with pytest.raises(ValueError):
        parse_record(record.replace(b"payload\r\n", b"PAYLOAD\r\n"))


def test_pages_go_to_python_in_small_batches(spark, tmp_path, monkeypatch):
    from dockflow.llm import warc

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept, planned, most = spark.conf.get(setting), warc.plan_records, warc.BATCH_ROWS

    def watched(*args):
        plan = planned(*args)

        def narrow(batches):
            for batch in batches:
                assert batch.num_rows <= most
                yield batch

        return plan.mapInArrow(narrow, plan.schema)

    monkeypatch.setattr(warc, "plan_records", watched)
    df = spark.range(1_000).selectExpr("id AS page_id", "CAST(null AS string) AS url", "repeat('x', 2000) || id AS html")
    write_warc(df.coalesce(1), str(tmp_path / "many"))
    assert spark.conf.get(setting) == kept
    assert read_warc(spark, str(tmp_path / "many")).count() == 1_000
