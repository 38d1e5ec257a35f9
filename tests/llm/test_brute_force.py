"""Operators against plain Python on small inputs."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from scholia.llm import bpe, chunk_dedup, decontaminate, langid, queries, secret_scan, simhash, suffix_dedup, toxicity
from scholia.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def texts_with_copies(seed=3, n=60):
    rnd = random.Random(seed)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(700))
    out = []
    for _ in range(n):
        body = "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(900)))
        kind = rnd.random()
        if kind < 0.4:
            x = rnd.randrange(400)
            body += passage[x : rnd.randrange(x + 100, 700)] + "".join(rnd.choice("ab") for _ in range(rnd.randrange(300)))
        elif kind < 0.5 and out:
            body = rnd.choice(out)
        elif kind < 0.6:
            body = rnd.choice(["ab " * 200, "z" * rnd.randrange(150, 500), "é日本" * 100])
        out.append(body)
    return out


def covered(raw, width=200):
    count = Counter(t[i : i + width] for t in raw for i in range(len(t) - width + 1))
    masks = []
    for t in raw:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                m[i : i + width] = True
        masks.append(m)
    return masks


@pytest.mark.parametrize("hot", [250, 1])
def test_suffix_dedup(spark, hot):
    texts = [*texts_with_copies(), None, ""]
    raw = [(t or "").encode() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.deduplicate(df, hot=hot).collect()}
    for k, (t, m) in enumerate(zip(raw, covered(raw))):
        runs = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"]) == (len(t), int(m.sum()), runs)
        assert bytes(got[k]["kept"]) == bytes(np.frombuffer(t, np.uint8)[~m])


def test_segments_cover_each_window_once():
    raw = np.frombuffer("".join(random.Random(1).choice("ab ") for _ in range(3000)).encode() + b"q" * 500, np.uint8)
    t0, t1, p, _ = suffix_dedup.segments(raw)
    assert sorted(w for x, y in zip(t0, t1) for w in range(x, y + 1)) == list(range(len(raw) - 199))
    assert ((t1 <= p) & (p <= t0 + 136)).all()


def test_chunks_rebuild_and_resist_shifts():
    rnd = random.Random(2)
    data = bytes(rnd.randrange(256) for _ in range(20_000)) + b"x" * 3_000
    cuts = chunk_dedup.cut_points(data)
    sizes = np.diff([0, *cuts])
    assert cuts[-1] == len(data) and sizes.min() > chunk_dedup.REACH and 80 < sizes[: len(sizes) // 2].mean() < 160
    pieces = lambda d: {d[x:y] for x, y in zip([0, *chunk_dedup.cut_points(d)], chunk_dedup.cut_points(d))}
    assert len(pieces(data) & pieces(b"inserted " + data)) >= 0.9 * len(pieces(data))


def test_gear_hash_is_the_rolling_one():
    data = np.frombuffer(bytes(random.Random(4).randrange(256) for _ in range(300)), np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert chunk_dedup.gear_hash(data).tolist() == want


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_borders_are_the_least_hashes_around(monkeypatch, block):
    monkeypatch.setattr(chunk_dedup, "BLOCK", block)
    rnd = random.Random(block)
    for n, letters in ((0, 256), (1, 256), (57, 256), (300, 256), (5_000, 256), (3_000, 2), (2_000, 1)):
        data = bytes(rnd.randrange(letters) for _ in range(n))
        h = chunk_dedup.gear_hash(np.frombuffer(data, np.uint8)).tolist() if n else []
        want, last = [], -1_000
        for i in range(n):
            if h[i] == min(h[max(0, i - 56) : i + 57]) and i + 1 - last > 56:
                want.append(i + 1)
                last = i + 1
        assert chunk_dedup.borders(data) == want
        ends = [p for p in want if 56 < p < n - 56]
        assert chunk_dedup.cut_points(data) == ([*ends, n] if n else [])


def test_chunk_dedup_against_brute_force(spark):
    texts = [*texts_with_copies(), None, ""]
    seen, want = set(), {}
    everywhere = Counter()
    cut = {}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        ends = chunk_dedup.cut_points(raw)
        cut[k] = [raw[x:y] for x, y in zip([0, *ends], ends)]
        everywhere.update(cut[k])
    for k, parts in cut.items():
        kept = []
        for c in parts:  # every later place of a chunk goes
            if c not in seen:
                kept.append(c)
            seen.add(c)
        want[k] = (b"".join(kept), sum(len(c) for c in parts if everywhere[c] > 1))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: (bytes(r["kept"]), r["n_shared"]) for r in chunk_dedup.deduplicate(df).collect()} == want


def test_passages_of_fifty_words_are_found_again(spark):
    """Passages of over 50 words, each in two texts at other places: nearly all are cut out of the second one, and texts with repeated short lines keep them."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 11)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rnd.randrange(51, 120)) for _ in range(300)]
    rows = [(k, text(rnd.randrange(5, 90)) + " " + p + " " + text(rnd.randrange(5, 90))) for k, p in enumerate(passages)]
    rows += [(1_000 + k, text(rnd.randrange(5, 90)) + " " + p + " " + text(rnd.randrange(5, 90))) for k, p in enumerate(passages)]
    line = "All rights reserved. Read the terms before use."
    rows += [(2_000 + k, f"{text(60)}\n{line}\n{text(60)}") for k in range(200)]
    got = {r["doc_id"]: r["n_removed"] for r in chunk_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed").collect()}
    assert sum(got[1_000 + k] > 0 for k in range(300)) >= 0.9 * 300
    assert all(got[k] == 0 for k in range(300)) and sum(got[2_000 + k] > 0 for k in range(200)) <= 4


def colliding_rows():
    """Two rows whose ids and texts have the same 64-bit hash by xxhash64, and unlike texts."""
    mask, p1, p2, p5 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5
    i1, i2 = pow(p1, -1, 1 << 64), pow(p2, -1, 1 << 64)
    turn = lambda x, n: ((x << n) | (x >> (64 - n))) & mask
    seeds = [xxhash.xxh64_intdigest(str(k).encode(), 42) for k in (1, 2)]
    rnd = random.Random(5)
    while True:  # a text of eight bytes is one lane, which a hash leads back to
        one = bytes(rnd.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(8))
        lane = turn(int.from_bytes(one, "little") * p2 & mask, 31) * p1 & mask
        lane ^= ((seeds[0] + p5 + 8) & mask) ^ ((seeds[1] + p5 + 8) & mask)
        other = (turn(lane * i1 & mask, 33) * i2 & mask).to_bytes(8, "little")
        if all(0x20 <= b < 0x7F for b in other):
            return (1, one.decode()), (2, other.decode())


def test_rows_with_the_same_64_bit_hash_stay_apart(spark):
    rows = colliding_rows()
    a, b = (xxhash.xxh64_intdigest(t.encode(), xxhash.xxh64_intdigest(str(k).encode(), 42)) for k, t in rows)
    assert a == b and rows[0][1] != rows[1][1]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], bytes(r["kept"]).decode()) for r in chunk_dedup.deduplicate(df).collect()} == set(rows)
    assert {tuple(r) for r in simhash.deduplicate(df).collect()} == set(rows)


def reference_encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_tiktoken(spark):
    told = reference_encoder()
    ours = bpe.Encoder(bpe.read_ranks(queries.RANKS), public_tokenizers.PATTERN)
    hard = ["", "a", "\x1c\x1d \x1e\x1fa", "\u0085  x  ", "a" * 3000, "日本語テキスト １２３ ½ ²", "don't I'LL we've", "   \n\n  x", "🙂🙂👩‍👩‍👧", "".join(map(chr, range(0x20, 0x3000))), "<|endoftext|>"]
    for t in hard:
        assert ours.encode(t).tolist() == told.encode_ordinary(t)
        assert ours.decode(ours.encode(t)) == t.encode()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op5_byte_bpe(spark, SF).collect():
        ids = np.array(told.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_perfect_hash_gives_each_key_a_slot():
    keys = [f"k{k}".encode() for k in range(5_000)]
    index = bpe.PerfectHash(keys)
    assert index.find(keys).tolist() == list(range(5_000))
    assert sorted(index.slot_key.tolist()) == list(range(5_000))


def plain_fingerprint(text):
    words = re.findall(rb"[^ \t-\r]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {k: plain_fingerprint(t) for k, t in docs.items()}
    got = {r["doc_id"]: r for r in queries.op6_simhash(spark, SF).collect()}
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{v:016x}" for k, v in fps.items()}
    assert {k: r["component_id"] for k, r in got.items()} == components(fps)


def components(fps):
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in fps}


def test_links_of_chosen_fingerprints(spark):
    rnd = random.Random(6)
    fps = {0, -1, 1, 3, 7, -(2**63), 2**62}
    for _ in range(40):
        x = rnd.getrandbits(63)
        fps |= {x, x ^ (1 << rnd.randrange(63)), x ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)), x ^ 0b111}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    nodes = {r["node"]: r["component"] for r in connected_components(simhash.links(df)).collect()}
    want = components({f: f & (2**64 - 1) for f in fps})
    groups = lambda m: sorted(sorted(f for f in fps if m.get(f, f) == c) for c in {m.get(f, f) for f in fps})
    assert groups(nodes) == groups(want)


def test_secret_scan_against_re(spark):
    kinds = {
        "assign": (re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
    }
    texts = [
        'token:token:abcdefgh password="hunter22" x', "🙂 API_KEY = 'zzzzzz' AKIA" + "A" * 16, "secret: ab AKIAAKIA" + "B" * 12, "f" * 24 + "g" + "0" * 23, None, "",
        "paſſword = abcdefgh", "passwd==longenough apikey:=x", "deadbeef" * 5 + " token=" + "deadbeef" * 4,
    ]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(20, texts[0]), (0, texts[0])], "doc_id long, text string")
    got = secret_scan.findings_by_path(df, secret_scan.scan(df)[0]).collect()
    for r in got:
        t = (texts[r["doc_id"]] if r["doc_id"] < 20 else texts[0]) or ""
        found = sorted((m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, (p, g, least)) in enumerate(kinds.items()) for m in p.finditer(t) if len(m[g]) >= least)
        assert r["spans"] == ",".join(x for *_, x in found)


def test_ledger_scans_only_unseen_pairs(spark):
    first = spark.createDataFrame([(1, "password = abcdef"), (2, "plain")], "doc_id long, text string")
    findings, ledger = secret_scan.scan(first)
    more = first.unionByName(spark.createDataFrame([(3, "password = abcdef"), (4, "token = 1234567")], "doc_id long, text string"))
    todo = secret_scan.unseen_pairs(more, ledger).collect()
    assert [(r["path"], sorted(r["kinds"])) for r in todo] == [(4, ["access", "assign", "hex"])]
    newer = tuple(secret_scan.Rule(r.kind, r.version + (r.kind == "hex"), r.pattern, r.group, r.min_length) for r in secret_scan.RULES)
    assert {(r["path"], *r["kinds"]) for r in secret_scan.unseen_pairs(first, ledger, newer).collect()} == {(1, "hex"), (2, "hex")}
    again, _ = secret_scan.scan(more, ledger, findings)
    assert {r["doc_id"]: r["n_assign"] for r in secret_scan.findings_by_path(more, again).collect()} == {1: 1, 2: 0, 3: 1, 4: 1}
    # after a new version of every rule its findings replace the old ones
    bumped = tuple(secret_scan.Rule(r.kind, r.version + 1, r.pattern, r.group, r.min_length) for r in secret_scan.RULES)
    history, grown = secret_scan.scan(more, ledger, findings)
    third, _ = secret_scan.scan(more, grown, history, bumped)
    told = {r["doc_id"]: (r["n_assign"], r["spans"]) for r in secret_scan.findings_by_path(more, third, bumped).collect()}
    assert told == {1: (1, "assign:0:17"), 2: (0, ""), 3: (1, "assign:0:17"), 4: (1, "assign:0:15")}
    assert third.where("version = 1").count() == third.where("version = 2").count() == 2


def plain_contamination(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(len(v), 13)
        for k in range(max(len(v) - 12, 1) if v else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == v[k : k + n]:
                    hit |= set(range(at, at + n))
                    ids.add(i)
    return len(w), len(hit), sorted(map(str, ids)), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_contamination_against_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    rnd = random.Random(8)
    vocabulary = [f"w{k}" for k in range(30)] + ["Ünï", "the", "THE"]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, say(rnd.choice([1, 3, 12, 13, 14, 30]))) for k in range(12)] + [(50, None), (51, "--"), (52, "w1 w1 w1")]
    texts = [say(rnd.randrange(60)) for _ in range(40)]
    for k in range(0, 40, 3):
        words = rnd.choice(items[:12])[1].split()
        texts[k] = say(9) + "; " + " ".join(words[: rnd.randrange(1, len(words) + 1)]).upper() + ", " + say(9)
    texts += [None, "", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.contamination(df, bench).collect():
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == plain_contamination(texts[r["doc_id"]], items)


def greedy_phrases(text, sample):
    """(phrases, bits) by trying every longer match."""
    n, bits, at = 0, 0.0, 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        bits += np.log2(len(sample) + 1) + 2 * np.log2(size + 1) if size else 9
        at, n = at + max(size, 1), n + 1
    return n, bits


@pytest.mark.parametrize("few", [0, 3, 1_000])
def test_phrases_are_greedy_longest_matches_of_whole_texts(few, monkeypatch):
    monkeypatch.setattr(langid, "FEW_LANES", few)
    rnd = random.Random(5)
    samples = {"a": b"abracadabra", "b": b"xyzzy", "c": bytes(rnd.choice(b"abxyz ") for _ in range(3_000))}
    model = langid.build(samples)
    texts = [b"abra", b"cadabraabracad", b"qqq", b"xyzzyabra", b"zyxab", b"", b"abra" * 700, b"q" + b"xyzzy" * 300 + b"\xff"]
    texts += [bytes(rnd.choice(b"abcdxyz q") for _ in range(rnd.randrange(400))) for _ in range(40)]
    count, bits = model.phrases(texts)
    want = [[greedy_phrases(t, s) for s in samples.values()] for t in texts]
    assert count.tolist() == [[n for n, _ in row] for row in want]
    assert np.allclose(bits, [[x for _, x in row] for row in want])


def test_a_tiny_sample_wins_nothing(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.where("lang IS NOT NULL").orderBy("doc_id").limit(120).collect()
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(r["text"])
    samples = {k: b" ".join(langid.normalised(t) for t in v[:-5]) for k, v in by_lang.items()}
    some = sorted(samples)[0]
    unequal = samples | {some: samples[some][:3_000], "tiny": b"q ", "letters": b"e n r i t a s o d l u"}
    model = langid.build(unequal)
    texts = [(k, t) for k, v in by_lang.items() for t in v[-5:] if len(t) > 200]
    got, _ = model.predict([t for _, t in texts])
    assert len(texts) > 8 and not {"tiny", "letters"} & set(got)
    assert sum(g == k for g, (k, _) in zip(got, texts)) / len(texts) > 0.9


def test_language_id_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in queries.op8_language_id(spark, sf).collect() if r["held_out"]]
    assert len(held) > 250 and sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held) > 0.98


def test_toxicity_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries.op4_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in toxic]
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in held)


def test_non_negative_risk_learns_the_marked_words():
    rnd = np.random.default_rng(0)
    pos = [np.unique(np.append(rnd.integers(100, 500, 20), 7)) for _ in range(60)]
    unl = [np.unique(rnd.integers(100, 500, 20)) if k % 10 else np.unique(np.append(rnd.integers(100, 500, 20), 7)) for k in range(600)]
    model = toxicity.fit(pos, unl, 0.1)
    assert model.score([7, 120]) > 0.5 > model.score([120, 130])
    assert toxicity.fit([], unl, 0.1).score([7]) == pytest.approx(0.1)


def test_gradient_of_the_risk():
    """Steps follow the slope of the risk, by differences; where the bracket is negative, its opposite."""
    rnd = np.random.default_rng(1)
    xp, xu, p, eps = rnd.random((30, 4)), rnd.random((90, 4)), 0.3, 1e-6
    losses = lambda w, b: (np.mean(-np.log(toxicity.sigmoid(xp @ w + b))), np.mean(-np.log(1 - toxicity.sigmoid(xu @ w + b))), np.mean(-np.log(1 - toxicity.sigmoid(xp @ w + b))))
    seen = set()
    for w, b in ((np.zeros(4), 0.0), (np.array([3.0, 2.0, 4.0, 1.0]), -1.0), (np.array([9.0, -8.0, 7.0, -9.0]), -14.0)):
        lp, un, pn = losses(w, b)
        negative = un - p * pn < 0
        seen.add(negative)
        risk = (lambda w: -(losses(w, b)[1] - p * losses(w, b)[2])) if negative else (lambda w: p * losses(w, b)[0] + losses(w, b)[1] - p * losses(w, b)[2])
        slope = [(risk(w + eps * e) - risk(w - eps * e)) / (2 * eps) for e in np.eye(4)]
        assert np.allclose(toxicity.gradient(np.append(w, b), *(np.hstack([x, np.ones((len(x), 1))]) for x in (xp, xu)), p)[:4], slope, atol=1e-5)
    assert False in seen
