"""URL rules, host rules and mixing against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dockflow.llm import host_rules
from dockflow.llm.host_rules import host_verdicts, judge_documents, keep_documents
from dockflow.llm.mixing import leaf_budgets, mix, repeated
from dockflow.llm.url_rules import judge_urls

RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
    ("block", "net", "/es/"), ("allow", "net", "/es/"), ("block", "com", "/a"), ("allow", "com", "/a/b"), ("block", "com", "/a/b/c"),
]


def split_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):]).group()


def by_hand(url):
    host, path = split_url(url)
    fits = [
        (len(h + p), len(h), v, h + p) for v, h, p in RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *((max(fits)[3], max(fits)[2]) if fits else (None, "allow")))


def test_urls_by_hand(spark):
    rng = random.Random(5)
    hosts = ["com", "Example.com", "www.example.com", "x.www.example.com", "net", "a.net", "notcom", "myexample.com", "", "É.net"]
    paths = ["", "/", "/en/1", "/en", "/es/q", "/a", "/a/b", "/a/bz", "/a/b/c/d", "/ab", "/A"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?x=/en/', '#y'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "a://b://c.com/en/"] + ["https://www.example.com/en/"] * 40
    df = spark.createDataFrame([(i % 50 or None, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = Counter(tuple(r) for r in judge_urls(df, rules, salt_rows=7).collect())
    assert got == Counter((i % 50 or None, *by_hand(u)) for i, u in enumerate(urls))
    assert judge_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in judge_urls(df, rules.limit(0), default="block").collect()} == {"block"}


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
    )


TEXTS = [
    None, "", " \n\t", "one", "a b c d e f g h " * 9, "a b c d e f g h", "a a a a a a a a a", "x " * 3000,
    "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 2 + " ".join(f"u{i}" for i in range(40)), "line\nline\n \nline \nother", "é#ü *$%&|<> 😀😀",
    "\x0bv\x0cf\r\n", "\xa0nbsp\xa0is a word",
]


def test_measures_by_hand(spark):
    rows = [(i % 9 or None, t, None if i % 4 == 0 else "h", 1) for i, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")
    got = Counter((r["doc_id"], *[r[c] for c in r.__fields__[1:6]], r["base_failed"]) for r in judge_documents(df).collect())
    want = Counter()
    for i, text, *_ in rows:
        m = measures(text)
        want[(i, *m, m[0] < 20 or 100 * m[4] > 30 * m[0])] += 1
    assert got == want
    assert judge_documents(df.limit(0)).count() == 0 and keep_documents(df.limit(0)).columns == df.columns


def test_bad_hosts_go_and_small_ones_are_judged_mildly(spark):
    good, bad = " ".join(f"g{i}" for i in range(30)), "short"
    rows = [(good, "fine")] * 95 + [(bad, "fine")] * 5 + [(good, "poor")] * 20 + [(bad, "poor")] * 80
    rows += [(good, f"site{i}") for i in range(30) for _ in range(20)] + [(bad, "tiny"), (good, "tiny"), (good, None), (bad, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string")
    kept = Counter(r["source"] for r in keep_documents(df).collect())
    assert kept["fine"] == 95 and kept["poor"] == 0 and kept["tiny"] == 1 and kept[None] == 1
    judged = df.withColumn("base_failed", F.col("text") == bad).withColumnRenamed("source", "host")
    rates = {r["host"]: r["host_rate"] for r in host_verdicts(judged).collect()}
    assert 0.5 < rates["poor"] < 0.8 and rates["tiny"] < 0.5
    assert Counter(r["kept"] for r in judge_documents(df).collect())[True] == sum(kept.values())


def test_keep_documents_writes_no_copy_of_the_texts(spark, monkeypatch):
    written, settle = [], host_rules.settle
    monkeypatch.setattr(host_rules, "settle", lambda df: written.append(df.columns) or settle(df))
    rows = [(i, " ".join(f"g{j}" for j in range(30 * (i % 3))), f"h{i % 5}", "x") for i in range(60)]
    rows += [(None, rows[1][1], None, "y")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host string")
    kept = keep_documents(df)
    verdicts = {(r["doc_id"], r["n_words"]): r["kept"] for r in judge_documents(df).collect()}
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(
        str(r) for r in df.collect() if verdicts[r["doc_id"], len(r["text"].split())]
    )
    assert written and not any({"row", "text"} & set(columns) for columns in written)


def fill(children, budget):
    """Shares by repeatedly capping the children that are full."""
    open_, given = dict(children), {}
    while open_:
        left = budget - sum(given.values())
        weight = sum(w for _, w in open_.values())
        full = [k for k, (c, w) in open_.items() if c * weight <= w * left]
        if not full:
            return given | {k: w * left // weight for k, (c, w) in open_.items()}
        for k in full:
            given[k] = open_.pop(k)[0]
    return given


def test_budgets_by_hand(spark):
    rng = random.Random(11)
    leaves = {(d, c, s): rng.randint(1, 4000) for d in "ab" for c in ("en", "fr", "") for s in "xyz" if rng.random() < 0.8}
    weights = {"domain": {"a": 7}, "lang": {"en": 5, "fr": 2}, "source": {"x": 3}}
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    for share in (0, 1, 3, 7, 10, 30):
        got = {tuple(r)[:3]: r["budget"] for r in leaf_budgets(df, F.expr(f"tokens * {share} DIV 10"), weights, 2).select("domain", "lang", "source", "budget").collect()}
        want, whole = {}, min(sum(leaves.values()) * share // 10, 2 * sum(leaves.values()))
        caps = Counter()
        for k, v in leaves.items():
            for n in (1, 2, 3):
                caps[k[:n]] += 2 * v
        level = {(): whole}
        for n, name in enumerate(("domain", "lang", "source")):
            below = {}
            for parent, budget in level.items():
                kids = {k: (c, weights[name].get(k[n], 1)) for k, c in caps.items() if len(k) == n + 1 and k[:n] == parent}
                below |= fill(kids, budget)
            level = below
        assert got == level


def test_prefixes_of_epochs(spark):
    rng = random.Random(2)
    rows = [(i // 2 if i < 20 else i, " ".join(["w"] * rng.randint(0, 9)), rng.choice(["en", None]), rng.choice("xy"), 5) for i in range(300)]
    rows += [(None, None, None, None, None), (None, "a b", None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epochs int")
    weights = {"lang": {"en": 9}, "source": {"x": 4}}
    out = mix(df, F.lit("d"), F.expr("tokens DIV 2"), weights, seed=3, range_docs=10)
    got = Counter((r["row"]["doc_id"], r["lang"], r["source"], r["n_tokens"], r["epochs"]) for r in out.collect())
    docs = [(d, lang or "", s or "", len((t or "").split())) for d, t, lang, s, _ in rows]
    tokens = Counter()
    for _, lang, s, n in docs:
        tokens["d", lang, s] += n
    leaves = spark.createDataFrame([(*k, v) for k, v in tokens.items() if v], "domain string, lang string, source string, tokens long")
    want = Counter()
    for leaf in leaf_budgets(leaves, F.expr("tokens DIV 2"), weights, 2).collect():
        whole, rest = divmod(leaf["budget"], leaf["tokens"])
        mine = [d for d in docs if d[1:3] == (leaf["lang"], leaf["source"]) and d[3]]
        key = lambda d: hashlib.md5(f"3:{whole}:{'' if d[0] is None else d[0]}".encode()).hexdigest()  # noqa: B023, E731
        for d in mine:
            upto = sum(e[3] for e in mine if key(e) <= key(d))
            if whole + (upto <= rest):
                want[(*d, whole + (upto <= rest))] += 1
    assert got == want
    assert repeated(out).columns == df.columns and repeated(out).count() == sum(k[-1] * n for k, n in got.items())
    assert mix(df.limit(0), F.lit("d"), F.expr("tokens"), {}).count() == 0


@pytest.mark.parametrize("epochs", [1, 3])
def test_everything_fits_where_the_budget_is_larger(spark, epochs):
    df = spark.createDataFrame([(i, "a b c", "en", "s") for i in range(9)], "doc_id long, text string, lang string, source string")
    out = mix(df, F.lit("d"), F.expr("tokens * 100"), {}, max_epochs=epochs)
    assert {r["epochs"] for r in out.collect()} == {epochs} and out.count() == 9
