"""Spelling variants against plain Python, and the index against a scan."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from dockflow.llm import spelling_variants as sv

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts_by_hand(docs, least=6):
    words = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                words[run] += 1
    return words


def by_hand(docs):
    words = {w: n for w, n in counts_by_hand(docs).items() if n >= 5}
    form, out = {}, {}
    for w, n in words.items():
        others = sorted((-k, v) for v, k in words.items() if near(w, v))
        form[w] = others[0][1] if others and -others[0][0] >= 5 * n else None
        out[w] = [len(others), form[w], words[form[w]] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return {w: (words[w], *rest) for w, rest in out.items()}


def documents():
    rng = random.Random(6)
    base = ["".join(rng.choices("abcdeéÿ×", k=rng.randint(5, 9))) for _ in range(15)] + ["abababab", "aaaaaaa", "x" * 300]
    pool = []
    for word in base:
        pool += [word] * 200
        for share in (30, 30, 6, 6, 6, 1, 1):
            at = rng.randrange(len(word))
            changed = rng.choice([word[:at] + word[at + 1 :], word[:at] + "z" + word[at:], word[:at] + "Q" + word[at + 1 :]])
            again = rng.randrange(len(changed))
            pool += [changed] * share + [changed[:again] + "ü" + changed[again + 1 :]] * (share // 3)
    docs = [(i, "".join(rng.choice(pool) + rng.choice([" ", ", ", "1", "\n", "日"]) for _ in range(60))) for i in range(80)]
    return docs + [(None, docs[0][1]), (None, docs[0][1]), (3, docs[3][1]), (90, None), (91, ""), (92, "1 2 \n")]


@pytest.mark.parametrize(("cap", "shard"), [(20_000, 20_000), (3, 60), (1, 10**9)])
def test_groups_by_hand(spark, cap, shard):
    docs = documents()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, word string")
    got = sv.group_variants(df, cap=cap, shard=shard)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = got.collect()
    assert len(rows) == len({r["word"] for r in rows})
    wanted = by_hand(docs)
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows} == wanted
    assert any(w[1] and w[4] != w[2] for w in ((None, *v) for v in wanted.values()) if w[3])
    assert sv.group_variants(df.limit(0)).count() == 0


def test_slips_and_slices():
    text = " ".join("".join(random.Random(i).choices("abcdefg", k=8)) for i in range(2000)) + " Éclairs " + "y" * 50
    whole = sv.written("7", text)
    assert {w.decode("latin-1"): n for w, n in whole.items()} == counts_by_hand([(7, text)])
    assert any(len(w) == 7 for w in whole)
    assert sv.written("7", text, size=64) == whole


@pytest.mark.parametrize("seed", range(4))
def test_one_error_against_a_scan(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choices("abc" if seed % 2 else "abcdefÿ", k=rng.randint(3, 14))) for _ in range(300)})
    words = list(dict.fromkeys([*words, "a" * 40, "a" * 39, "b" + "a" * 39]))
    for flip in (False, True):
        some = [w[::-1] if flip else w for w in words]
        length = np.array([len(w) for w in some])
        for part in (lambda n: (n // 2, n), lambda n: (n // 2, (n // 2 + n) // 2 + (n > 5)), lambda n: (0, n)):
            lo, hi = (np.array(x) for x in zip(*(part(n) for n in length)))
            got = set(map(tuple, sv._search(some, length, length, lo, hi).tolist()))
            for i, w in enumerate(some):
                for j, v in enumerate(some):
                    if len(v) == len(w):
                        at = [k for k in range(len(w)) if v[k] != w[k]]
                        want = len(at) == 1 and lo[i] <= at[0] < hi[i]
                    else:
                        want = any(v[:k] + v[k + 1 :] == w for k in range(lo[i], hi[i] + 1)) and len(v) == len(w) + 1
                    assert ((i, j) in got) == want, (w, v)
