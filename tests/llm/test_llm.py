"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and against
brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, xs, extra=()):
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in xs], SCHEMA)
    for name in extra:
        df = df.withColumn(name, F.lit(7))
    return df


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (4, "a b c"), (5, "a  b\tc"), (6, "É ß ẞ ﬁ " * 3), (None, "no id here"), (None, None), (7, "wörd " * 30_000), (8, "x" * 50_000)]
CLASH = ["score", "h", "t", "keep_id", "kept", "copy", "shuffle_key", "fp", "label", "chunk", "rules", "key", "_s", "_n", "_u"]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD, CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, odd, empty):
    from strandwise.llm.exact_dedup import drop_duplicates, exact_dedup

    got = [tuple(r) for r in exact_dedup(odd).collect()]
    assert len(got) == len(ODD)
    fold = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in ODD:
        groups.setdefault(fold(t), []).append(i)
    for i, keep, size, _, sha in got:
        mine = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == sha)
        ids = [x for x in mine if x is not None]
        assert i in mine and size == len(mine) and keep == (min(ids) if ids else None)
    assert sum(r[3] for r in got) == len(groups)
    assert exact_dedup(empty).count() == 0
    kept = drop_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_exact_dedup_where_digests_collide_and_groups_are_hot(spark):
    from strandwise.llm.exact_dedup import exact_dedup

    xs = [(i, f"text {i % 7}") for i in range(200)] + [(i, "hot") for i in range(200, 400)]
    d = docs(spark, xs)
    want = sorted(map(tuple, exact_dedup(d).collect()))
    for digest in (lambda t: F.substring(F.md5(t), 1, 1), lambda t: F.lit("same")):
        assert sorted(map(tuple, exact_dedup(d, digest, hot_rows=50, salts=4).collect())) == want
    assert sorted(map(tuple, exact_dedup(d, hot_rows=50, salts=4).collect())) == want


def test_mixing(spark, odd, empty):
    from strandwise.llm.mixing import poisson_mix, rates

    d = docs(spark, [(i, "abc") for i in range(6000)])
    n = Counter(r.source for r in poisson_mix(d, {"s0": 3, "s1": 1}).collect())
    assert set(n) == {"s0", "s1"} and abs(n["s0"] - 4500) < 300 and abs(n["s1"] - 1500) < 200
    got = poisson_mix(d, {"s0": 3, "s1": 1}).groupBy("doc_id").count().groupBy("count").count().collect()
    k = {r[0]: r[1] for r in got}
    assert abs(k[2] - 2000 * (math.exp(-2.25) * 2.25**2 / 2) - 2000 * math.exp(-0.75) * 0.75**2 / 2) < 120
    assert sorted(map(tuple, poisson_mix(d).collect())) == sorted(map(tuple, poisson_mix(d.repartition(7)).collect()))
    assert poisson_mix(empty).count() == 0 and rates(empty).count() == 0
    n = Counter(r.doc_id for r in poisson_mix(odd).collect())
    mean = {r.source: r.rate for r in rates(odd).collect()}
    assert set(n) <= {i for i, _ in ODD} and sum(n.values()) < 6 * sum(mean[f"s{(i or 0) % 3}"] for i, _ in ODD) + 20
    numbered, plain = poisson_mix(odd), poisson_mix(odd, numbered=False)
    assert numbered.columns[-2:] == ["copy", "shuffle_key"] and plain.columns == odd.columns
    assert {(r.copy, r.shuffle_key) for r in plain.collect()} == {(7, 7)} and plain.count() == numbered.count()


def test_mixing_of_a_tiny_source_beside_a_huge_one(spark):
    from strandwise.llm.mixing import poisson_mix, rates

    huge = spark.range(4000).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.lit("en").alias("lang"), F.lit("huge").alias("source"), F.lit(1000).cast("long").alias("n_chars"))
    d = huge.toDF("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(-1, "y", "en", None, 1)], SCHEMA))
    rate = {r.source: r.rate for r in rates(d).collect()}
    assert 1900 < rate[""] < 2100  # the defaults
    got = [r.copy for r in poisson_mix(d).filter("doc_id = -1").collect()]
    assert abs(len(got) - rate[""]) < 6 * rate[""] ** 0.5 and sorted(got) == list(range(len(got)))
    # Mean and variance of many draws at a rate of 1,950, beside one drawn at once.
    many = docs(spark, [(i, "abcd") for i in range(900)])
    n = poisson_mix(many.select("doc_id", "text", "lang", F.when(F.col("doc_id") < 300, "a").otherwise("b").alias("source"), "n_chars"), {"a": 650, "b": 1}, epochs=651).groupBy("source", "doc_id").count().collect()
    a = np.array([r["count"] for r in n if r.source == "a"])
    assert len(a) == 300 and abs(a.mean() - 1950) < 6 * (1950 / 300) ** 0.5 and 0.6 < a.var() / 1950 < 1.5
    assert len(set(a)) > 100


def brute_simhash(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, odd, empty):
    from strandwise.llm.simhash import drop_near_duplicates, simhash_components

    got = simhash_components(odd).collect()
    assert len(got) == len(ODD)
    want = Counter((i, f"{brute_simhash(t):016x}") for i, t in ODD)
    assert Counter((r.doc_id, r.fingerprint) for r in got) == want
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert simhash_components(empty).count() == 0
    assert drop_near_duplicates(odd).columns == odd.columns


def test_near_duplicates_with_null_and_repeated_ids(spark):
    from strandwise.llm.simhash import drop_near_duplicates, fingerprint

    r = random.Random(3)
    a, b, c, d, e = (" ".join(str(r.getrandbits(32)) for _ in range(400)) for _ in range(5))
    near = a + " more"
    assert 0 < (fingerprint(a) ^ fingerprint(near)).bit_count() <= 4
    rows = [(1, a), (2, near), (2, b), (2, c), (None, d), (None, e), (None, e), (3, e), (None, a)]
    want = Counter([(1, a), (2, b), (2, c), (None, d), (3, e)])
    for parts in (1, 5):
        assert Counter((x.doc_id, x.text) for x in drop_near_duplicates(docs(spark, rows).repartition(parts)).collect()) == want


def test_simhash_components_against_all_pairs(spark):
    from strandwise.llm.simhash import simhash_components

    r = random.Random(15)
    words = [f"w{k}" for k in range(4000)]
    xs, i = [], 0
    for _ in range(40):
        t = [r.choice(words) for _ in range(r.choice([30, 200, 500]))]
        for _ in range(r.randint(1, 6)):
            xs.append((i * 7 % 1009, " ".join(t)))
            t = list(t)
            t[r.randrange(len(t))] = r.choice(words)
            i += 1
    xs += [(2000, None), (2001, "  "), (None, xs[0][1]), (3, xs[1][1])]
    fp = [brute_simhash(t) for _, t in xs]
    up = list(range(len(xs)))

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a in range(len(xs)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                up[find(a)] = find(b)
    least = {}
    for a, (doc_id, _) in enumerate(xs):
        if doc_id is not None:
            least[find(a)] = min(doc_id, least.get(find(a), doc_id))
    want = Counter((doc_id, f"{fp[a]:016x}", least[find(a)]) for a, (doc_id, _) in enumerate(xs))
    assert Counter(map(tuple, simhash_components(docs(spark, xs)).collect())) == want
    assert 20 < len(set(least.values())) < len(xs) - 10


def test_simhash_index_finds_all_links():
    from strandwise.llm.simhash import blocks_for, gray_rank, masks, node_links

    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    x = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randrange(0, 7))) for b in base for _ in range(12)})
    a = np.array(x, dtype=np.uint64)
    found = node_links(a, leaf=8)

    def classes(links):
        up = {v: v for v in x}

        def find(v):
            while up[v] != v:
                v = up[v]
            return v

        for p, q in links:
            p, q = find(p), find(q)
            up[max(p, q)] = min(p, q)
        return [find(v) for v in x]

    near = [(p, q) for i, p in enumerate(x) for q in x[:i] if (p ^ q).bit_count() <= 4]
    assert classes(found) == classes(near) and all((p ^ q).bit_count() <= 4 for p, q in found)
    for n in (10, 10**6, 10**8, 10**10):
        ms = masks(list(range(64)), blocks_for(n))
        for _ in range(200):
            d = sum(1 << k for k in r.sample(range(64), 4))
            assert any(not m & d for m in ms)
    ranks = np.arange(1 << 10, dtype=np.uint64)
    assert (gray_rank(ranks ^ (ranks >> np.uint64(1))) == ranks).all()


def test_simhash_links_where_top_nodes_are_split(spark):
    from strandwise.llm.components import components
    from strandwise.llm.simhash import links

    r = random.Random(6)
    base = r.getrandbits(64)
    x = sorted({base ^ sum(1 << k for k in r.sample(range(64), 3)) for _ in range(60)} | {r.getrandbits(64) for _ in range(20)})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in x], "fp bigint")
    one, two = (sorted(map(tuple, components(links(df, len(x), split=s)).collect())) for s in (10**6, 5))
    assert one == two and len({c for _, c in one}) == 1


def test_components_against_union_find(spark):
    from strandwise.llm.components import components

    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    up = {v: v for e in edges for v in e}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(16)).collect()}
    loose = {v for e in edges if e[0] == e[1] for v in e} - set(got)
    assert got == {v: find(v) for v in up if v not in loose}


def test_byte_bpe(spark, odd, empty):
    import base64

    import public_tokenizers as P
    import tiktoken
    from strandwise.llm.byte_bpe import decode_ids, encode, encode_ids

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, x in ODD:
        ids = t.encode_ordinary(x or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()] += 1
    for long in (65536, 400, 20):
        assert Counter(map(tuple, encode(odd, long=long).collect())) == want
    assert encode(empty).count() == 0
    back = decode_ids(encode_ids(odd)).collect()
    assert Counter(bytes(r.bytes).decode() for r in back) == Counter(x or "" for _, x in ODD)


def test_byte_bpe_chunks_and_merges():
    import tiktoken
    from strandwise.llm import byte_bpe as b

    path, pat = b.default_vocabulary()
    e = b.Encoder.load(path, pat)
    t = tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=e.ranks, special_tokens={}).encode_ordinary
    r = random.Random(8)
    joined = 0
    for _ in range(400):
        s = "".join(r.choice(" \n\t'  abcé1２!?sretvldm　😀") for _ in range(r.randint(0, 200))) + r.choice(["", " " * 80, "a" * 300 + "x", "!?" * 90])
        want = t(s)
        assert e.encode(s) == want and e.decode(want) == s.encode()
        size = r.choice([20, 30, 60])
        joint, got = b.Stitcher(), []
        for _, part, last in b.cut(s, size, 20):
            got += joint.add(*b.encode_chunk(e, part, size, 20, last)).tolist()
        got += joint.rest().tolist()
        if joint.fine:
            joined += 1
            assert got == want
    assert joined > 50
    alike = [chr(c) for c in range(128)]
    for _ in range(300):
        s = "".join(r.choice(alike + list(" 's abc12")) for _ in range(60))
        assert e.ascii.findall(s) == e.find.findall(s)
    assert b.ascii_pattern(r"(?i:a)|\\w+") is None and b.ascii_pattern(r"[\\S]") is None
    for p in (b"a" * 500, bytes(range(256)) * 2, "ab" * 300):
        p = p if isinstance(p, bytes) else p.encode()
        assert b"".join(e.bytes[i] for i in e.merge(p)) == p


def test_fingerprints(spark, odd, empty):
    from strandwise.llm.fingerprint import canonical, fingerprints, shared_digests, xxh3

    xs = [(i, t) for i, t in ODD if i not in (4, None)] + [(9, "Same  Text"), (10, "same text"), (None, "z")]
    got = {r.doc_id: r for r in fingerprints(docs(spark, xs, CLASH)).collect()}
    order = sorted(xs, key=lambda x: -1 if x[0] is None else x[0], reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        edited = t[: n - n // 3] + nxt[: n // 3]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (xxh3(canonical(t)), xxh3(canonical(edited)))
        assert r.near_next == float(canonical(t) == canonical(nxt))
    assert got[9].fingerprint == got[10].fingerprint and got[10].near_next == 1.0
    assert fingerprints(odd).count() == len(ODD) and fingerprints(empty).count() == 0
    one = fingerprints(docs(spark, [(1, "abcdef")])).collect()[0]
    assert one.near_next == 1.0
    short = lambda form: xxh3(form)[:8] if form else "0" * 8
    assert not shared_digests(docs(spark, xs), short)
    clash = lambda form: "ab" * 16
    assert "ab" * 16 in shared_digests(docs(spark, xs), clash) and "cd" * 16 not in shared_digests(docs(spark, xs), clash)
    split = {r.fingerprint for r in fingerprints(docs(spark, xs), clash).collect()}
    assert len(split) == len({canonical(t or "") for _, t in xs})


SECRETS = [(1, 'api_key = "abcDEF123" password:hunter2 PassWd=xx SECRET: token: abcdefgh'), (2, "AKIA" + "A" * 16 + " AKIAB akia" + "B" * 20), (3, "é" * 5 + "0123456789abcdef01234567 0123456789abcdef0123456"), (4, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20 + " xoxb-1234567890ab"), (5, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK AIza" + "B" * 35), (6, "tokENtoken=token=abcdefgh toKen"), (7, None), (None, "token=abcdefg"), (8, "x" * 30_000 + " secret=abcdef"), (8, "")]


def test_secrets(spark, empty):
    from strandwise.llm.secrets import RULES, find_secrets, trigram_query

    want = Counter()
    for i, t in SECRETS:
        spans, n = [], Counter()
        for k, u in enumerate(RULES):
            for m in re.finditer(u.pattern, t or ""):
                if len(m.group(u.group)) >= u.least:
                    spans.append((m.start(), k, u.kind, m.end()))
                    n[u.kind] += 1
        show = lambda xs: ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(xs))
        want[i, n["assign"], n["access"], n["hex"], hashlib.sha256(show([s for s in spans if s[1] < 3]).encode()).hexdigest(), show(spans)] += 1
    assert Counter(map(tuple, find_secrets(docs(spark, SECRETS, CLASH)).collect())) == want
    assert find_secrets(empty).count() == 0
    assert trigram_query("ab[cd]e+f") == {frozenset(["abc"]), frozenset(["abd"])}
    assert trigram_query("[0-9a-f]+") == {frozenset()}
    assert trigram_query("abcd|xyz") == {frozenset(["abc", "bcd"]), frozenset(["xyz"])}


def test_secrets_in_a_text_of_many(spark):
    import time

    from strandwise.llm.secrets import find_secrets

    for n in (63, 64, 65, 4097):
        text = "é " + "token=abcdef%06d " * n % tuple(range(n))
        spans = find_secrets(docs(spark, [(1, text)])).collect()[0].spans.split(",")
        assert spans == [f"assign:{m.start()}:{m.end()}" for m in re.finditer(r"token=abcdef\d{6}", text)]
    many = docs(spark, [(1, "0123456789abcdef01234567 " * 100_000)])
    began = time.time()
    row = find_secrets(many).collect()[0]
    assert row.n_hex == 100_000 and row.spans.endswith("hex:2499975:2499999") and time.time() - began < 100


def corpus(n=600):
    r = random.Random(9)
    words = {"en": "the and of to in is that for it was on are as with his they at be this from".split(), "de": "der die und das ist nicht ein für auf mit sich den von zu im dem".split(), "fr": "le la et les des en un du une que est pour qui dans sur pas".split()}
    return [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(3, 60))), lang) for i in range(n) for lang in [r.choice(list(words))]]


def test_language(spark, odd, empty):
    from strandwise.llm.language import language

    xs = corpus()
    d = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in xs] + [(9000, None, "en", "s", 0), (9001, "123 !?", "de", "s", 1), (9002, "", None, "s", 0)], SCHEMA)
    got = {r.doc_id: r for r in language(d).collect()}
    out = [(i, lang) for i, _, lang in xs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in out) and np.mean([got[i].lang_pred == lang for i, lang in out]) > 0.97
    assert [(got[i].lang_pred, got[i].score) for i in (9000, 9001, 9002)] == [("und", 0.0)] * 3
    assert language(empty).count() == 0 and language(odd).count() == len(ODD)
    nothing = language(d.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_language_against_plain_counts(spark):
    from strandwise.llm.language import MAX_N, SMOOTHING, UNKNOWN, grams, predict, train

    xs = corpus(150) + [(900, "the the die", "en"), (901, "the the die", "de"), (902, "xyz", None), (903, None, "fr"), (904, "7 8", "fr")]
    d = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in xs], SCHEMA).repartition(5)
    places = len(grams(["a"])[0][0]) and MAX_N << 14
    counts, texts = {}, Counter()
    for _, t, lang in xs:
        if t is not None and lang is not None:
            texts[lang] += 1
            for n, p in enumerate(grams([t])[0]):
                counts.setdefault(lang, [Counter() for _ in range(MAX_N)])[n].update(p.tolist())

    def odds(t, lang):
        total = math.log(texts[lang] / sum(texts.values()))
        for n, p in enumerate(grams([t])[0]):
            own = counts[lang][n]
            every = sum(own.values()) + SMOOTHING * places / MAX_N
            total += sum(math.log((own[x] + SMOOTHING) / every) for x in p.tolist())
        return total

    for group in (256, 2, 1):
        got = {r.doc_id: r for r in predict(d, train(d, group)).collect()}
        for i, t, _ in xs:
            if not t or not any(c.isalpha() for c in t):
                assert (got[i].lang_pred, got[i].score) == (UNKNOWN, 0.0)
                continue
            o = {lang: odds(t, lang) for lang in counts}
            best = max(sorted(o), key=o.get)
            assert o[got[i].lang_pred] == pytest.approx(o[best], abs=1e-3)
            assert got[i].score == pytest.approx(1 / sum(math.exp(x - o[best]) for x in o.values()), rel=1e-2)


def test_toxicity(spark, odd, empty):
    from strandwise.llm.toxicity import drop_toxic, toxicity

    r = random.Random(10)
    bad = "idiot moron scum loser".split()
    xs = [(i, t + (" " + " ".join(r.sample(bad, 2)) if i % 5 == 0 else "")) for i, t, _ in corpus(1500)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in xs] + [(1, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity(docs(spark, xs), labels).collect()
    held = [x for x in got if x.held_out]
    assert np.mean([x.predicted == int(x.doc_id % 5 == 0) for x in held]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    kept = drop_toxic(docs(spark, xs, ["score"]), labels)
    assert kept.columns == docs(spark, xs, ["score"]).columns and not {x.doc_id for x in kept.collect()} & set(range(0, 1400, 35))
    assert toxicity(odd, labels).count() == len(ODD) and toxicity(empty, labels).count() == 0
    # Nothing to learn from, or one label only: nothing is toxic.
    for none in (labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1"), labels.filter("toxic is null")):
        assert {(x.predicted, round(x.score, 6)) for x in toxicity(odd, none).collect()} == {(0, 0.25)}
        assert Counter(map(tuple, drop_toxic(odd, none).collect())) == Counter(map(tuple, odd.collect()))
    # Ids that repeat with different texts, in any order.
    both = docs(spark, xs + [(i, t + " again") for i, t in xs[:300]])
    one, two = (sorted((x.doc_id, round(x.score, 6), x.predicted) for x in toxicity(d, labels).collect()) for d in (both, both.repartition(5)))
    assert one == two


def test_calibration_reaches_its_least_loss():
    from strandwise.llm.toxicity import calibrate

    r = np.random.default_rng(3)
    odds = np.concatenate([r.normal(-30, 40, 900), r.normal(20, 40, 60)])
    y = np.repeat([0, 1], [900, 60])
    a, b = calibrate(odds, y)
    loss = lambda a, b: np.logaddexp(0, np.where(y == 1, -1, 1) * (a * odds + b)).sum() + (a - 1) ** 2 / 2 + 1e-2 * b * b / 2
    assert all(loss(a, b) <= loss(a + x, b + z) for x in (-0.02, 0, 0.02) for z in (-0.1, 0, 0.1))


def test_calibration_of_odds_that_tell_nothing_or_the_contrary():
    from strandwise.llm.toxicity import LEAST_SLOPE, calibrate

    r = np.random.default_rng(4)
    odds = np.concatenate([r.normal(30, 40, 900), r.normal(-20, 40, 60)])
    y = np.repeat([0, 1], [900, 60])
    a, b = calibrate(odds, y)
    loss = lambda b: np.logaddexp(0, np.where(y == 1, -1, 1) * (a * odds + b)).sum() + 1e-2 * b * b / 2
    assert a == LEAST_SLOPE and loss(b) < min(loss(b - 0.1), loss(b + 0.1))
    p = 1 / (1 + np.exp(-a * odds - b))
    assert p.mean() == pytest.approx(y.mean(), abs=1e-3)


def test_quality(spark, odd, empty):
    from strandwise.llm.quality import quality

    xs = [(i, t.upper().replace(" ", "!! ") if i % 4 == 0 else t) for i, t, _ in corpus(900)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _ in xs if i % 3], "doc_id bigint, quality int, toxic int")
    got = quality(docs(spark, xs), labels).collect()
    assert np.mean([x.predicted == int(x.doc_id % 4 != 0) for x in got]) > 0.95
    assert quality(odd, labels).count() == len(ODD) and quality(empty, labels).count() == 0
    assert len({round(x.score, 9) for x in quality(odd, labels.limit(0)).collect()}) == 1
    contrary = labels.unionByName(labels.filter("doc_id % 5 = 1").withColumn("quality", 1 - F.col("quality")))
    mixed = docs(spark, xs + xs[:50] + [(i, None) for i, _ in xs[:20]])
    one, two = (sorted((x.doc_id, round(x.score, 6), x.predicted) for x in quality(d, contrary).collect()) for d in (mixed, mixed.repartition(7)))
    assert len(one) == 970 and one == two


def test_co_training_uses_the_pool():
    from strandwise.llm.quality import co_train

    r = np.random.default_rng(1)
    make = lambda y: (np.unique(r.integers(0, 50, 4) + 50 * y + 200 * r.integers(0, 2, 4)).astype(np.int32), np.unique(r.integers(0, 8, 3) + 8 * y).astype(np.int32))
    labelled = [(*make(y), y) for y in r.integers(0, 2, 60)]
    pool = [make(y) for y in r.integers(0, 2, 400)]
    truth = r.integers(0, 2, 300)
    tests = [make(y) for y in truth]
    acc = [np.mean((co_train(labelled, p)[0].odds([x[0] for x in tests]) > 0) == truth) for p in (pool, [])]
    assert acc[0] > acc[1] + 0.2


def test_language_model(spark, odd, empty):
    from strandwise.llm.language_model import score

    xs = [(i, t) for i, t, _ in corpus(300)] + [(i + 10_000, t) for i, t in ODD if i]
    tokens = lambda t: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [None]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in xs if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for size in (12_000_000, 20_000):
        got = score(docs(spark, xs, CLASH), size).collect()
        assert len(got) == len(xs)
        by = {}
        for i, t in xs:
            by.setdefault(i, []).append(t)
        for r in got:
            w = tokens(by[r.doc_id][0])
            base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(base) and r.score < 0
    assert score(odd).count() == len(ODD) and score(empty).count() == 0


def test_language_model_with_repeated_and_null_ids(spark):
    from strandwise.llm.language_model import score

    long = " ".join(f"w{i % 977} w{i}" for i in range(60_000))
    xs = [(1, "a b"), (1, "c d e"), (1, "a b"), (2, long), (None, "x"), (None, "x y"), (None, None), (3, "")]
    got = score(docs(spark, xs, CLASH).repartition(3), 1000).collect()
    size = lambda t: len((t or "").split()) + 1
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, size(t)) for i, t in xs)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    alike = [r.score for r in got if r.doc_id == 1 and r.n_tokens == 3]
    assert alike[0] == pytest.approx(alike[1])
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    assert [(r.score, r.base_score, r.train_tokens) for r in score(docs(spark, [(i, "a b") for i in held])).collect()] == [(0.0, 0.0, 0)] * 3


def test_tables_are_drawn_from_their_distribution():
    from strandwise.llm.language_model import draw_tables

    for c, d, a in ((2, 0.6, 0.3), (9, 0.3, 2.0), (32, 0.8, 0.5), (400, 0.7, 0.2), (400, 0.7, 6.0), (3000, 0.5, 1.5)):
        w = np.array([a])  # by the recursion of the Stirling numbers, scaled
        for k in range(1, c):
            t = np.arange(1, len(w) + 1)
            w = np.append((k - d * t) * w, 0) + np.concatenate(([0], a * w))
            w /= w.max()
            w = w[:200]
        w /= w.sum()
        got = draw_tables(np.full(40_000, c), np.full(40_000, a), d, np.random.default_rng(1))
        p = np.bincount(got, minlength=len(w) + 1)[1:] / 40_000
        assert np.abs(p[: len(w)] - w).sum() < 0.06, (c, d, a)


def test_language_model_messages_do_not_grow_with_the_square_of_partitions(spark, monkeypatch):
    from strandwise.llm import language_model as lm

    made, drop = Counter(), lm._Table.drop

    def counted(self, *kinds):
        made.update({k: self.of(k).count() for k in kinds})
        drop(self, *kinds)

    monkeypatch.setattr(lm._Table, "drop", counted)
    r = random.Random(6)
    xs = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(2000))) for i in range(8)]
    spark.conf.set("spark.sql.shuffle.partitions", "36")
    try:
        got = lm.score(docs(spark, xs), burn_in=1, samples=1).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((x.doc_id, x.n_tokens) for x in got) == [(i, 2001) for i in range(8)]
    # Each bucket with a row and a column of 6 shards, which share one; 36 * 36 where each tells all.
    assert 0 < made[lm._BASE] <= 36 * 11 and 0 < made[lm._TABLES] <= 36 * 11 and 0 < made[lm._SUMS] <= 2 * 36 * 11


def test_language_model_shards_cover_any_number_of_partitions():
    from strandwise.llm.language_model import _grid, _shard

    for n in [*range(1, 60), 211]:
        rows, columns = _grid(n)
        u, w = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        owner = _shard(u, w, n)
        assert set(owner.tolist()) == set(range(rows * columns)) and n - rows < rows * columns <= n
        of = Counter(x for x, _ in set(zip(u.tolist(), owner.tolist())))
        assert set(of.values()) == {columns}  # a restaurant is a whole row's
        assert set(Counter(x for x, _ in set(zip(w.tolist(), owner.tolist()))).values()) == {rows}


def gibbs_by_customer(texts, d, sweeps, seed=4):
    """Seats every customer by himself; averaged predictive probabilities of (context, word)."""
    r = random.Random(seed)
    pairs = [(a, b) for t in texts for a, b in zip([None, *t.split()], [*t.split(), None])]
    words = {w for _, w in pairs}
    tables, root = {}, {}  # sizes of tables

    def p_root(w):
        n, m = sum(map(sum, root.values())), sum(map(len, root.values()))
        own = root.get(w, [])
        return (sum(own) - d * len(own) + (1 + d * m) / (len(words) + 1)) / (1 + n)

    def p_word(u, w):
        own = {x: s for (v, x), s in tables.items() if v == u}
        n, m, mine = sum(map(sum, own.values())), sum(map(len, own.values())), own.get(w, [])
        return (sum(mine) - d * len(mine) + (1 + d * m) * p_root(w)) / (1 + n)

    def sit(at, key, opens):
        own = at.setdefault(key, [])
        x = r.random() * (opens + sum(own) - d * len(own))
        for k, n in enumerate(own):
            x -= n - d
            if x < 0:
                own[k] += 1
                return False
        own.append(1)
        return True

    def leave(at, key):
        own = at[key]
        k = r.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            return True
        return False

    def add(u, w):
        m = sum(len(s) for (v, _), s in tables.items() if v == u)
        if sit(tables, (u, w), (1 + d * m) * p_root(w)):
            sit(root, w, (1 + d * sum(map(len, root.values()))) / (len(words) + 1))

    for u, w in pairs:
        add(u, w)
    total = Counter()
    for k in range(sweeps):
        for u, w in pairs:
            if leave(tables, (u, w)):
                leave(root, w)
            add(u, w)
        if k >= sweeps // 4:
            for u in words:
                for w in words:
                    total[u, w] += p_word(u, w) / (sweeps - sweeps // 4)
    return total


def test_language_model_against_customers_seated_one_by_one(spark, monkeypatch):
    from strandwise.llm import language_model

    monkeypatch.setattr(language_model, "discount", lambda *_: 0.5)
    r = random.Random(12)
    follow = {w: r.choices("abcdef", k=3) for w in "abcdef"}
    texts = []
    for _ in range(40):
        t = [r.choice("abcdef")]
        while len(t) < 6:
            t.append(r.choice(follow[t[-1]] if r.random() < 0.8 else "abcdef"))
        texts.append(" ".join(t))
    xs = list(enumerate(texts))
    learnt = [t for i, t in xs if zlib.crc32(str(i).encode()) % 7 != 2]
    p = gibbs_by_customer(learnt, 0.5, 400)
    got = {x.doc_id: x.score for x in language_model.score(docs(spark, xs), burn_in=4, samples=8).collect()}
    for i, t in xs:
        want = sum(math.log10(p[a, b]) for a, b in zip([None, *t.split()], [*t.split(), None]))
        assert got[i] == pytest.approx(want, rel=0.02)


def test_pipeline(spark):
    import corpus_pipeline as c

    data = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{data}/documents.parquet")
    columns, sizes = d.columns, [d.count()]
    for name, f in c.STAGES[:-1]:
        d = f(spark, d, data)
        assert d.columns == columns, name
        d = c.materialise(d, "test")
        sizes.append(d.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
    assert c.encode(d).count() == sizes[4] == c.run(spark, data).count()
    empty = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, f in c.STAGES:
        assert f(spark, empty, data).count() == 0


def test_pipeline_stages_keep_what_they_should(spark, odd, tmp_path):
    """On nulls, repeated ids, other columns and no labels: each stage keeps just the rows that brute force keeps."""
    import corpus_pipeline as c

    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(c.STAGES)
    rows = lambda d: Counter((r.doc_id, r.text) for r in d.collect())
    clean = stages["toxicity"](spark, odd, str(tmp_path))
    assert rows(clean) == Counter(ODD) and clean.columns == odd.columns
    once = c.materialise(stages["exact_dedup"](spark, clean, str(tmp_path)), "test")
    fold = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert Counter(fold(r.text) for r in once.collect()) == Counter({fold(t) for _, t in ODD})
    near = c.materialise(stages["near_dedup"](spark, once, str(tmp_path)), "test")
    left = [(r.doc_id, r.text) for r in once.collect()]
    prints = {brute_simhash(t) for _, t in left}
    assert all((a ^ b).bit_count() > 4 for a in prints for b in prints if a != b)
    assert Counter(brute_simhash(r.text) for r in near.collect()) == Counter(prints) and not rows(near) - Counter(left)
    mixed = c.materialise(stages["mixing"](spark, near, str(tmp_path)), "test")
    assert mixed.columns == odd.columns and set(rows(mixed)) <= set(rows(near))
    assert stages["encoding"](spark, mixed, str(tmp_path)).count() == mixed.count()


def test_registered_queries_equal_their_sql(spark):
    import os

    import duckdb
    from strandwise.llm import queries

    data, con = "/root/testdata/sf0.001", duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, data).toPandas(), con.execute(sql).df()
        same = [sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None))) for df in (got, want)]
        assert sorted(got.columns) == sorted(want.columns) and same[0] == same[1], name
