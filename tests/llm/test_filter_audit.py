"""The filter audit against plain Python."""

import random
import re
from itertools import permutations

from scholia.llm import filter_audit


def brute(docs, labels):
    good = {i for i, q, t in labels if q == 1}
    toxic = {i for i, q, t in labels if t == 1}
    key = lambda i: (i is None, i or 0)
    masks = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = any((u or "") == t and key(j) < key(i) for j, u, _ in docs)
        fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), e)
        masks.append((s or "", {x for x, f in zip("ABCDE", fails) if f}, i in good, i in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        removed = {}
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                here = [m for m in left if x in m[1]]
                left = [m for m in left if x not in m[1]]
                out[part, "".join(order), k + 1] = [len(left), len(here), sum(x in m[1] for m in mine) - len(here), sum(m[1] == {x} for m in mine), sum(m[2] for m in here), sum(m[3] for m in here)]
                removed[x] = removed.get(x, 0) + len(here)
        for (p, o, k), v in out.items():
            if p == part and len(v) == 6:
                v.append(removed[o[k - 1]])
    return out


def run(spark, docs, labels):
    df = spark.createDataFrame([(i, t, s, "x", 1, False) for i, t, s in docs], "doc_id long, text string, source string, digest string, n int, good boolean")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in filter_audit.audit(df, marks).collect()}


def test_audit_of_every_mask(spark):
    rnd = random.Random(4)
    docs = []
    for i in range(260):
        n = rnd.choice([10, 60, 90])
        words = [rnd.choice(["Aa", "BBB", "c"]) if rnd.random() < rnd.choice([0, 0.6]) else f"w{rnd.randrange(10**6)}" for _ in range(n)]
        text = rnd.choice([" ", "\t\n", "\x0b"]).join(words) + rnd.choice(["", "", " #", "|"])
        docs.append((i, text, rnd.choice(["a", "b", None])))
    docs += [(300 + k, docs[k][1], rnd.choice(["a", "b", ""])) for k in range(60)]
    rnd.shuffle(docs)
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 300, 2)]
    got, want = run(spark, docs, labels), brute(docs, labels)
    assert got == want and len(got) == 3 * 600
    assert len({v[1] for v in got.values()}) > 10


def test_edges_of_the_audit(spark):
    long = "word " * 100_000
    docs = [(1, None, "a"), (2, "", "a"), (2, "", "b"), (None, "", "a"), (None, None, None), (5, long, "c"), (5, long, "c"), (4, "same", None), (4, "same", "a"), (6, "same", "a"), (7, "é#", "c"), (None, "alone", "c"), (None, "alone", "c")]
    labels = [(2, 1, 1), (2, 0, None), (5, None, 1), (None, 1, 1)]
    got, want = run(spark, docs, labels), brute(docs, [x for x in labels if x[0] is not None])
    assert got == want
    assert run(spark, docs, []).keys() == got.keys()
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_orders_are_all_permutations(spark):
    got = run(spark, [(1, "x", "s")], [])
    assert sorted({k[1] for k in got}) == ["".join(o) for o in permutations("ABCDE")] and {k[2] for k in got} == {1, 2, 3, 4, 5}
    assert all(got["s", o, k][0] == (0 if "A" in o[:k] else 1) for _, o, k in got)
