"""The registered queries of the training-data operators, with SQL where it can express them.

Each applies its operator with production parameters to whole tables and derives the agreed columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.llm import (
    bpe_codec,
    host_rules,
    language_id,
    line_quality,
    mixing,
    ranked_search,
    shingle_join,
    spelling_variants,
    token_counts,
    toxicity,
    url_rules,
    vector_graph,
    warc,
)
from dockflow.llm.shared import held_out, table
from dockflow.session import scratch_path


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return vector_graph.near_duplicate_vectors(table(spark, sf_dir, "embeddings")).drop("recall")


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id, vec_id AS reached FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.a
"""

#: Weights of the mix by level; nodes not named weigh 1. Of all tokens a half is asked for, and two epochs at most.
MIX_WEIGHTS = {"domain": {"a": 5, "b": 3, "c": 2}, "lang": {"en": 4, "fr": 3, "de": 2, "es": 3}, "source": {}}
MIX_SEED = 17


def mix_domain(source: str = "source") -> Column:
    """A domain for each source: by the first digit of its md5."""
    digest = F.md5(F.coalesce(F.col(source), F.lit("")))
    return F.when(digest < "6", "a").when(digest < "b", "b").otherwise("c")


def mix_budget() -> Column:
    return F.expr("tokens DIV 2")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how many epochs take them."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mix_domain(), mix_budget(), MIX_WEIGHTS, seed=MIX_SEED)
    return mixed.select("row.doc_id", *mixing.TREE, "n_tokens", "epochs")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _fill_sql(name: str, nodes: str, parents: list[str], level: str, weights: dict) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())
    weight = f"CASE {level} {cases} ELSE 1 END" if weights else "1"
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    keys = ", ".join([*parents, level])
    order = f"{part} ORDER BY capacity / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
    {name}_w AS (SELECT *, CAST({weight} AS BIGINT) AS weight FROM ({nodes})),
    {name}_f AS (SELECT *, sum(weight) OVER ({part}) AS total,
        capacity * (sum(weight) OVER ({part}) - coalesce(sum(weight) OVER ({order}), 0))
        <= weight * (budget - coalesce(sum(capacity) OVER ({order}), 0)) AS is_full FROM {name}_w),
    {name} AS (SELECT {keys}, CAST(CASE WHEN is_full THEN capacity ELSE
        weight * (budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({part}))
        // (total - sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER ({part})) END AS BIGINT) AS budget FROM {name}_f)"""


OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len({_WORDS}) AS BIGINT) AS n_tokens,
    CASE WHEN md5(coalesce(source, '')) < '6' THEN 'a' WHEN md5(coalesce(source, '')) < 'b' THEN 'b' ELSE 'c' END AS domain
    FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(2 * sum(n_tokens) AS BIGINT) AS capacity
    FROM d WHERE n_tokens > 0 GROUP BY ALL),
{_fill_sql("l1", "SELECT domain, sum(capacity) AS capacity, (SELECT sum(tokens) // 2 FROM leaf) AS budget FROM leaf GROUP BY domain",
           [], "domain", MIX_WEIGHTS["domain"])},
{_fill_sql("l2", "SELECT domain, lang, sum(capacity) AS capacity, any_value(budget) AS budget FROM leaf JOIN l1 USING (domain) "
           "GROUP BY domain, lang", ["domain"], "lang", MIX_WEIGHTS["lang"])},
{_fill_sql("l3", "SELECT domain, lang, source, capacity, budget FROM leaf JOIN l2 USING (domain, lang)",
           ["domain", "lang"], "source", MIX_WEIGHTS["source"])},
k AS (SELECT d.*, budget // tokens AS whole, budget % tokens AS rest,
    md5('{MIX_SEED}:' || (budget // tokens) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
    FROM d JOIN leaf USING (domain, lang, source) JOIN l3 USING (domain, lang, source) WHERE n_tokens > 0),
e AS (SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN
    sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) <= rest THEN 1 ELSE 0 END AS BIGINT) AS epochs FROM k)
SELECT * FROM e WHERE epochs > 0
"""


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    coded = bpe_codec.encode_decode(table(spark, sf_dir, "documents"), vocabulary())
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those not held out."""
    documents = table(spark, sf_dir, "documents")
    languages = language_id.learn_languages(documents, ~held_out())
    found = language_id.predict_languages(documents, languages)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    folder = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder, payloads=False).drop("url", "payload")


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and which are over 2048 tokens."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary())
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and near-duplicate components of all documents."""
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 4], ' ') AS shingle FROM
    (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS pos FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n AS x ON p.a = x.doc_id JOIN n AS y ON p.b = y.doc_id
    WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
r AS (SELECT doc_id, doc_id AS reached FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""

#: Score from which a document counts as good.
GOOD = 0.7


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labelled ones not held out."""
    documents = table(spark, sf_dir, "documents")
    field = line_quality.learn_field(documents, table(spark, sf_dir, "labels"), ~held_out())
    scored = line_quality.score_texts(documents, field)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents."""
    return host_rules.judge_documents(table(spark, sf_dir, "documents")).drop("host_rate")


OP9_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
g AS (SELECT r, unnest(range(1, len(words) - 6)) AS pos, words FROM w WHERE len(words) > 8),
s AS (SELECT r, pos, array_to_string(words[pos:pos + 7], ' ') AS s FROM g),
t AS (SELECT r, pos, count(*) OVER (PARTITION BY r, s) AS n FROM s),
c AS (SELECT r, sum(least(8, coalesce(next_pos - pos, 8))) AS n FROM
    (SELECT r, pos, lead(pos) OVER (PARTITION BY r ORDER BY pos) AS next_pos FROM t WHERE n > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w),
x AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT w.doc_id, w.source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(x.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN c USING (r) LEFT JOIN x USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(f / n) AS mean, greatest(var_pop(f / n) - avg(f / n) * (1 - avg(f / n)) * avg(1 / n), 0) AS v FROM h),
q AS (SELECT mean, CASE WHEN v <= 0 THEN 1e9 ELSE greatest(mean * (1 - mean) / v - 1, 0) END AS k FROM p),
j AS (SELECT source, (f + mean * k) / (n + k) <= 0.5 AS host_kept FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce(host_kept, TRUE) AS kept
FROM b LEFT JOIN j USING (source)
"""

#: Verdict, host and path of the rules on pages.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the URL of every page."""
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


OP10_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
u AS (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN ''
    ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT p.r, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule,
    arg_max(verdict, length(rules.host || rules.path)) AS verdict
    FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)
    GROUP BY p.r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (r)
"""


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP11_SQL = f"""
WITH q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM d WHERE len(terms) > 0),
t AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS nl FROM s),
p AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM s)
    WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, t GROUP BY term, nd),
c AS (SELECT p.r, p.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nd) // nl)))) AS c
    FROM p JOIN w USING (term) JOIN s USING (r), t),
x AS (SELECT item_id, r, CAST(sum(c) AS BIGINT) AS score FROM c JOIN q USING (term) GROUP BY ALL),
k AS (SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM x JOIN s USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
"""


#: Score from which a document counts as toxic.
TOXIC = 0.5


def toxicity_held_out(id_column: str = "doc_id") -> Column:
    """True where 5 divides crc32 of the id as text; such rows never train the toxicity network. Null ids are false."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labelled ones not held out."""
    documents = table(spark, sf_dir, "documents")
    net = toxicity.learn_net(documents, table(spark, sf_dir, "labels"), ~toxicity_held_out())
    scored = toxicity.score_texts(documents, net)
    predicted = F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", toxicity_held_out().alias("held_out"), "score", predicted)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents, and the form each is a variant of."""
    return spelling_variants.group_variants(table(spark, sf_dir, "documents"))


#: crc32 of the bytes of ``<doc_id>:<run>``, whose characters are all Latin-1.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '')
    || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
    ELSE [CAST(192 + unicode(c) // 64 AS BIGINT), CAST(128 + unicode(c) % 64 AS BIGINT)] END))),
    lambda a, b: xor(a >> 8, steps[CAST(xor(a, b) & 255 AS INTEGER) + 1])), CAST(4294967295 AS BIGINT))"""

OP13_SQL = f"""
WITH RECURSIVE c AS (SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END) AS v FROM range(256) AS r(i))),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
    GROUP BY ALL HAVING length(run) >= 6),
h AS (SELECT run, n, {_CRC} AS h FROM r, c),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
    ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
e AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
x AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM e AS a JOIN e AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, a.n, v.word, v.n FROM e AS a JOIN v ON a.rest = v.word
    UNION SELECT v.word, v.n, b.word, b.n FROM e AS b JOIN v ON b.rest = v.word),
k AS (SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place FROM x),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form,
    CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN k ON v.word = k.word AND place = 1),
p AS (SELECT word, word AS root, form AS further FROM f UNION ALL
    SELECT p.word, f.word, f.form FROM p JOIN f ON p.further = f.word)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN p ON f.word = p.word AND p.further IS NULL
"""

QUERIES = {
    "op1_vector_graph": (op1_vector_graph, OP1_SQL),
    "op2_mixing": (op2_mixing, OP2_SQL),
    "op3_bpe_codec": (op3_bpe_codec, None),
    "op4_language_id": (op4_language_id, None),
    "op5_warc": (op5_warc, OP5_SQL),
    "op6_token_counts": (op6_token_counts, None),
    "op7_shingle_join": (op7_shingle_join, OP7_SQL),
    "op8_line_quality": (op8_line_quality, None),
    "op9_host_rules": (op9_host_rules, OP9_SQL),
    "op10_url_rules": (op10_url_rules, OP10_SQL),
    "op11_ranked_search": (op11_ranked_search, OP11_SQL),
    "op12_toxicity": (op12_toxicity, None),
    "op13_spelling_variants": (op13_spelling_variants, OP13_SQL),
}
