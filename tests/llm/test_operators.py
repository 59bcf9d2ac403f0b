"""Operators on Spark: odd rows, brute force, round trips and held-out accuracy."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.llm import embeddings, html, jaccard, langid, packing, quality, rules, sentencepiece, sharding, toxicity
from spotweave.llm.families import components, least_reachable

from .conftest import LONG, ODD
from .test_kernels import brute_base, brute_shingles


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (7, 7), (20, 19), (19, 18), (18, 25), (25, 30), (30, 17), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 17: 17, 18: 17, 19: 17, 20: 17, 25: 17, 30: 17}


def brute_components(edges):
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    return least


def test_components_in_one_task_and_in_rounds(spark):
    rng = np.random.default_rng(3)
    cases = [[(i, i + 1) for i in range(100)], [(50, i) for i in range(100)], [(-5, 9), (9, 2**62)], [(4, 4)]]
    cases += [rng.integers(0, 150, (n, 2)).tolist() for n in (30, 75, 200)]
    for edges in cases:
        want = brute_components(edges)
        apart = np.array([e for e in edges if e[0] != e[1]], np.int64).reshape(-1, 2)
        nodes, least = least_reachable(apart[:, 0], apart[:, 1])
        assert dict(zip(nodes.tolist(), least.tolist())) == want
    for edges in cases[1], cases[3], cases[5]:
        df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
        for limit in (1 << 20, 0):
            assert {r["node"]: r["component"] for r in components(df, limit).collect()} == brute_components(edges)


def test_few_edges_are_no_rounds(spark):
    """Each round sends the driver about ten stages; a long path of few edges took several."""
    sc = spark.sparkContext
    df = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    sc.setJobGroup("few edges", "")
    try:
        assert {r["component"] for r in components(df).collect()} == {0}
        assert len(sc.statusTracker().getJobIdsForGroup("few edges")) <= 6
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


# Sharding -------------------------------------------------------------------------------------------------------------


def test_shuffle_keeps_rows_and_sizes(docs, odd, empty):
    for df, shards in ((docs, 7), (odd, 5)):
        out = sharding.uniform_shuffle(df, shards).collect()
        assert sorted(r["text"] or "" for r in out) == sorted(r["text"] or "" for r in df.collect())
        sizes = Counter(r["shard"] for r in out)
        assert max(sizes.values()) - min(sizes.get(j, 0) for j in range(shards)) <= 1
        for j, n in sizes.items():
            assert sorted(r["slot"] for r in out if r["shard"] == j) == list(range(n))
    assert sharding.uniform_shuffle(empty, 3).count() == 0


def test_shuffle_is_uniform(spark):
    """Over seeds, each row is in each shard equally often."""
    df = spark.range(12).coalesce(1)
    at = Counter()
    for seed in range(25):
        at.update((r["id"], r["shard"]) for r in sharding.uniform_shuffle(df, 3, seed).select("id", "shard").collect())
    assert len(at) == 36 and max(at.values()) < 20
    assert sharding.uniform_shuffle(df, 3, 5).collect() == sharding.uniform_shuffle(df, 3, 5).collect()


# Packing --------------------------------------------------------------------------------------------------------------


def test_pack(spark, odd, empty):
    from tokenizers import Tokenizer

    path = packing.tokenizer_file(packing.TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    out = packing.pack(odd, path, capacity=256, with_ids=True).collect()
    want = Counter()
    for r in odd.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 256 or 256
        cuts = [0, *range(head, len(ids), 256), len(ids)]
        want.update((r["doc_id"], i, a, tuple(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in out) == want
    by = defaultdict(list)
    for r in out:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by[r["sequence_id"]].append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert len(by) <= -(-sum(r["length"] for r in out) // 256) + 1
    assert packing.pack(empty, path).count() == 0
    joined = packing.sequences(spark.createDataFrame(out)).collect()
    assert sorted(len(r["ids"]) for r in joined) == sorted(sum(r["length"] for r in rows) for rows in by.values())


# Language -------------------------------------------------------------------------------------------------------------


def test_language_held_out(docs):
    held = langid._remainder(5) == 0
    out = langid.identify(docs.withColumn("held_out", held), langid.fit(docs, ~held)).collect()
    assert len(out) == docs.count()
    tested = [r for r in out if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in tested]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_of_odd_rows(docs, odd, empty):
    model = langid.fit(docs, F.lit(True))
    out = langid.identify(odd, model)
    assert set(out.columns) == {*odd.columns, "lang_pred"}
    for r in out.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    assert langid.identify(empty, model).count() == 0
    nothing = langid.fit(empty, F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_language_of_many_copies(spark, docs):
    """Copies neither push a language out of the sample nor add to its n-grams."""
    distinct = docs.select("doc_id", "lang", "text").dropDuplicates(["text"]).cache()
    many = distinct.filter("lang = 'fr'").orderBy("doc_id").limit(20).crossJoin(spark.range(100).select("id")).drop("id")
    rows = distinct.filter("lang = 'en'").unionByName(many)
    model = langid.fit(rows, F.lit(True), 30)
    out = langid.identify(distinct.filter("lang = 'fr'").withColumn("is", F.col("lang")), model).collect()
    assert np.mean([r["lang_pred"] == r["is"] for r in out]) > 0.9
    hot = distinct.filter("lang = 'en'").orderBy("doc_id").limit(1).crossJoin(spark.range(2000).select("id")).drop("id")
    one, other = (langid.fit(d, F.lit(True)) for d in (distinct, distinct.unionByName(hot)))
    assert (one.planes == other.planes).all()
    single = spark.createDataFrame([(i, "xx", "zuvolo kidrami pentuga") for i in range(5)], "doc_id bigint, lang string, text string")
    model = langid.fit(distinct.unionByName(single), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(single, model).collect()} == {"xx"}


# Quality and toxicity ---------------------------------------------------------------------------------------------------


def _accuracy(rows, truth, name):
    return np.mean([r[name] == truth[r["doc_id"]] for r in rows if r["doc_id"] in truth])


def test_quality_held_out(docs, labels, odd, empty):
    model = quality.fit(docs, labels, "quality", quality._remainder() != 1)
    truth = {r["doc_id"]: r["quality"] for r in labels.filter(quality._remainder() == 1).collect()}
    assert _accuracy(quality.score(docs, model).collect(), truth, "predicted") > 0.93
    out = quality.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert len({r["score"] for r in out if r["text"] == ODD[6]}) == 1
    assert quality.score(empty, model).count() == 0
    assert quality.score(odd, quality.fit(empty, labels, "quality", F.lit(True))).count() == odd.count()


def test_toxicity_held_out(docs, labels, odd, empty):
    model = toxicity.fit(docs, labels, "toxic", toxicity._remainder() != 0)
    truth = {r["doc_id"]: r["toxic"] for r in labels.filter(toxicity._remainder() == 0).collect()}
    assert _accuracy(toxicity.grade(docs, model).collect(), truth, "toxic") > 0.9
    out = toxicity.grade(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["severity"] <= 3 and r["kept"] == (r["toxic"] == 0) for r in out)
    assert toxicity.grade(empty, model).count() == 0


# Rules ------------------------------------------------------------------------------------------------------------------


def brute_kneser_ney(texts, langs):
    """log_ppl by the definition, with dictionaries."""
    order, counts = rules.ORDER, defaultdict(Counter)
    symbols = []
    for t, lang in zip(texts, langs):
        s, blank = [], False
        for c in t:
            if c.isspace() and blank:
                continue
            blank = c.isspace()
            s.append(" " if blank else c)
        s = [None] * (order - 1) + s
        symbols.append(s)
        for i in range(order - 1, len(s)):
            counts[lang][tuple(s[i - order + 1 : i + 1])] += 1
    levels = {}
    for lang, c in counts.items():
        levels[lang] = {order: c}
        for k in range(order, 1, -1):
            lower = Counter()
            for g, n in levels[lang][k].items():
                lower[g[1:]] += int(n >= (2 if k == order else 1))
            levels[lang][k - 1] = lower

    def discounts(c, top):
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        if not any(n):
            return (1.0 if top else 0.5, 1.0, 1.5)
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
        raw = [1 - 2 * y * n[1] / n[0] if n[0] else 0.5, 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        d = [min(max(v, 0.05), i + 0.95) for i, v in enumerate(raw)]
        return (1.0 if top else d[0], d[1], d[2])

    def probability(lang, g):
        k = len(g)
        c = levels[lang][k]
        d = discounts(c, k == order)
        cut = lambda n: 0.0 if n == 0 else d[min(n, 3) - 1]
        same = [n for h, n in c.items() if h[:-1] == g[:-1]]
        total, free = sum(same), sum(map(cut, same))
        below = probability(lang, g[1:]) if k > 1 else 1 / rules.N_SYMBOLS
        return ((c[g] - cut(c[g])) / total if total else 0.0) + (free / total if total else 1.0) * below

    out = []
    for s, lang in zip(symbols, langs):
        logs = [np.log(probability(lang, tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))]
        out.append(-np.mean(logs) if logs else None)
    return out


def test_perplexity_is_the_definition(spark):
    texts = ["the cat sat on the mat the cat", "a dog ate the  cat\nat the door", "le chat est la", "", "the cat sat on the mat the cat", "zq", "\u4f60\u597d \u4f60\u597d\x00 \U0001f600\U0001f601", "\u0434\u0430 \u0434\u0430 \u0434\u0430"]
    langs = ["en", "en", "fr", "en", None, "en", "zh", "ru"]
    df = spark.createDataFrame(list(zip(range(8), langs, texts)), "doc_id int, lang string, text string")
    want = brute_kneser_ney(texts, [x or "" for x in langs])
    for shard_rows in (rules.SHARD_ROWS, 20):  # whole, and in ranges
        got = {r["doc_id"]: r["log_ppl"] for r in rules.measure(df, shard_rows).collect()}
        for i, w in enumerate(want):
            assert (got[i] is None and w is None) or got[i] == pytest.approx(w, rel=1e-5)


def test_rules(docs, odd, empty):
    out = rules.judge(docs).collect()
    assert len(out) == docs.count()
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in out:
        b = brute_base(text[r["doc_id"]])
        assert [r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]] == b
        assert r["base_failed"] == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert r["kept"] == (not r["base_failed"] and r["band_low"] <= r["log_ppl"] <= r["band_high"])
    sound = [r["kept"] for r in out if not r["base_failed"]]
    assert np.mean(sound) > 0.9
    strange = rules.judge(odd).collect()
    assert len(strange) == odd.count()
    assert all(r["base_failed"] for r in strange if r["n_words"] < 50)
    assert rules.judge(empty).count() == 0


def test_bands_separate(spark, docs, labels):
    """Labelled and planted junk goes, labelled good texts stay, and texts that fail the base rules don't vouch for others."""
    plain = docs.select("doc_id", "lang", "text")
    truth = {r["doc_id"]: r["quality"] for r in labels.filter("quality is not null").collect()}
    out = rules.judge(plain).collect()
    sound = {q: [r["kept"] for r in out if not r["base_failed"] and truth.get(r["doc_id"]) == q] for q in (0, 1)}
    assert np.mean(sound[1]) > 0.95 and np.mean(sound[0]) < 0.7
    clean = [r["text"] for r in plain.filter("lang = 'en'").collect() if truth.get(r["doc_id"]) == 1 and 80 < len(r["text"].split()) < 400][:20]
    junk = [" | ".join(t.split()[::2]) + " |" for t in clean] + ["".join(sorted(t)) + " " + " ".join(t.split()[:60]) for t in clean]
    rows = spark.createDataFrame([(10**9 + i, "en", t) for i, t in enumerate(junk)], "doc_id bigint, lang string, text string")
    got = [r for r in rules.judge(plain.unionByName(rows)).collect() if r["doc_id"] >= 10**9 and not r["base_failed"]]
    assert len(got) >= 20 and np.mean([r["kept"] for r in got]) < 0.1
    short = spark.createDataFrame([(2 * 10**9 + i, "en", "qzx vvk " * 10) for i in range(300)], "doc_id bigint, lang string, text string")
    with_short = {r["doc_id"]: r["log_ppl"] for r in rules.judge(plain.unionByName(short)).collect()}
    assert all(with_short[r["doc_id"]] == pytest.approx(r["log_ppl"], rel=1e-5) for r in out if not r["base_failed"])


# Near copies --------------------------------------------------------------------------------------------------------------


def brute_links(texts):
    """Links by brute force, and the smallest id reached."""
    sets = {i: brute_shingles(t or "") for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    common = Counter()
    for h in holders.values():
        for a in range(len(h)):
            for b in range(a + 1, len(h)):
                common[h[a], h[b]] += 1
    links, top = Counter(), {i: i for i in texts}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in texts}


def test_jaccard_join(docs):
    want = brute_links({r["doc_id"]: r["text"] for r in docs.collect()})
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard.join(docs).collect()}
    assert got == want


def test_jaccard_join_in_small_blocks(spark):
    """A large group of different near copies, cut into many blocks."""
    base = [f"w{i}" for i in range(300)]
    texts = {i: " ".join(base[:k] + [f"x{i}"] + base[k + 1 :]) for i, k in enumerate(range(5, 295, 7))}
    texts |= {100 + i: " ".join(base[i:]) for i in range(0, 60, 6)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard.join(df, bucket_block=8, family_block=8).collect()}
    assert got == brute_links(texts)


def test_jaccard_join_of_odd_rows(spark, odd, empty):
    out = jaccard.join(odd).collect()
    assert len(out) == odd.count()
    copies = [r for r in out if r["doc_id"] in (6, 7) or r["doc_id"] is None]
    assert {r["n_links"] for r in copies} == {3} and {r["class_id"] for r in copies} == {6}
    for r in out:
        if r["doc_id"] in (0, 1, 2, 3):
            assert (r["n_links"], r["class_id"], r["kept"]) == (0, r["doc_id"], True)
    assert jaccard.join(empty).count() == 0
    kept = jaccard.stage(spark, odd, "")
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([None, 0, 1, 2, 3, 4, 5, 6, 8, 9, 10])


def _vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    near = base[:20] + 0.08 * rng.normal(size=(20, 16))
    more = base[:20] + 0.2 * rng.normal(size=(20, 16))
    crowd = base[0] + 0.05 * rng.normal(size=(40, 16))
    x = np.concatenate([base, near, more, crowd]).astype(np.float32)
    label = np.concatenate([np.arange(60) % 2, np.arange(20) % 2, np.arange(20) % 2, np.zeros(40, int)])
    return x, label


def test_embeddings(spark):
    x, label = _vectors()
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(len(x))]
    odd = [(200, None, 0), (201, [], 0), (202, [0.0] * 16, 0), (203, [float("nan")] + [1.0] * 15, 0), (204, [None] + [1.0] * 15, 0), (205, rows[0][1], None), (206, [float("inf")] * 16, 1), (207, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (0, rows[0][1], 0), (208, [-v for v in rows[0][1]], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    # Row 0 is there twice.
    n = linked.sum(axis=1) - 1 + linked[0]
    top = np.arange(len(x))
    while True:
        new = np.where(linked, top[None, :], 10**9).min(axis=1)
        if (new == top).all():
            break
        top = new
    out = embeddings.near_copies(df, block=8, miss=25.0).collect()
    assert len(out) == len(rows) + len(odd)
    for r in out:
        if r["vec_id"] is not None and r["vec_id"] < 200:
            assert (r["n_links"], r["component_id"], r["kept"]) == (n[r["vec_id"]], top[r["vec_id"]], top[r["vec_id"]] == r["vec_id"])
        elif r["vec_id"] in (207, None):
            assert (r["n_links"], r["component_id"]) == (1, 207)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True)
    assert embeddings.near_copies(df.filter("false")).count() == 0


def test_embedding_recall(spark):
    """Neighbours just over and just under the threshold, planted beside each vector of a table, with the shipped settings."""
    rng = np.random.default_rng(8)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter("embedding is not null and label is not null").orderBy("vec_id").collect()
    base, label = np.array([r["embedding"] for r in rows], float), np.array([r["label"] for r in rows])
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    parts = [base]
    for low, high in ((0.9301, 0.935), (0.931, 0.945), (0.90, 0.9299)):
        cosine = rng.uniform(low, high, len(base))[:, None]
        away = rng.normal(size=base.shape)
        away -= (away * base).sum(axis=1, keepdims=True) * base
        parts.append(cosine * base + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away, axis=1, keepdims=True))
    v, label = np.concatenate(parts), np.tile(label, len(parts))
    df = spark.createDataFrame([(i, x, int(k)) for i, (x, k) in enumerate(zip(v.tolist(), label))], "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_copies(df).collect()}
    found = want = 0
    for k in np.unique(label):
        at = np.flatnonzero(label == k)
        n = (v[at] @ v[at].T >= embeddings.THRESHOLD).sum(axis=1) - 1
        mine = np.array([got[i] for i in at])
        assert (mine <= n).all()
        found, want = found + mine.sum(), want + n.sum()
    assert want >= 2 * 2 * len(base) and found >= 0.999 * want


@pytest.mark.parametrize("largest", [200, 2_000, 20_000, 200_000])
def test_caps_of_isolated_pairs(largest):
    """Pairs at the threshold share a cap under production parameters, and caps stay as small as they should be."""
    codes = embeddings.product_codes(64, largest)
    x, y = embeddings.random_pairs(2000, 64, embeddings.THRESHOLD, np.random.default_rng(3))
    met, dealt, directions = np.zeros(len(x), bool), 0, 0
    for code in codes:
        (row, at), (other, there) = code.decode(x), code.decode(y)
        met[np.intersect1d(row * code.size**2 + at, other * code.size**2 + there) // code.size**2] = True
        dealt, directions = dealt + len(row), directions + code.size**2
    assert met.all()
    share = min(0.25, embeddings.CAP_ROWS / largest)
    assert 0.7 * share < dealt / len(x) / directions < 1.3 * share


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_isolated_pairs_of_a_label(spark, n):
    """100 pairs at a cosine just over the threshold, alone in a label of n rows, all link and nothing else does."""
    rng = np.random.default_rng(n)
    x, y = embeddings.random_pairs(100, 64, 0.9301, rng)
    v = np.concatenate([x, y, rng.normal(size=(n - 200, 64))])
    rows = spark.createDataFrame([(i, e, 0) for i, e in enumerate(v.tolist())], "vec_id bigint, embedding array<double>, label int")
    out = embeddings.near_copies(rows).filter("n_links > 0").collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == {i: (1, i % 100) for i in range(200)}


# Pages and pieces -------------------------------------------------------------------------------------------------------


def test_pages(spark):
    rows = [(1, "u", "<body><article><p>one</p></article></body>", "x", 5), (1, "u", "<body><article><p>one</p></article></body>", "x", 5), (2, None, None, None, None), (None, "v", "", None, None), (3, "w", "<p>" + LONG + "</p>", None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars bigint")
    out = html.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter((r["page_id"], r["text"]) for r in out.collect()) == Counter([(1, "one"), (1, "one"), (2, ""), (None, ""), (3, LONG)])
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert html.extract(df.filter("false")).count() == 0


def test_fixture_pages_give_their_article(spark):
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        plain = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", article))
        assert r["text"] == " ".join(unescape(plain).split())


def test_sentencepiece_round_trip(spark, odd, empty):
    import sentencepiece as library

    path = packing.tokenizer_file(sentencepiece.TOKENIZER)
    pieces = sentencepiece.load(path)
    processor = library.SentencePieceProcessor(model_file=path)
    encoded = sentencepiece.encode(odd, pieces)
    back = sentencepiece.decode(encoded.drop("text"), pieces)
    assert set(encoded.columns) == set(odd.columns)
    for r in encoded.collect():
        assert r["ids"] == processor.encode(r["text"] or "")
    assert Counter(r["text"] for r in back.collect()) == Counter(r["text"] or "" for r in odd.collect())
    assert sentencepiece.encode(empty, pieces).count() == 0 and sentencepiece.decode(empty.select(F.array(F.lit(1)).alias("ids")), pieces).count() == 0
    null = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r["text"] for r in sentencepiece.decode(null, pieces).collect()] == ["", ""]


def test_sentencepiece_query_has_one_worker_a_task(spark, odd):
    pieces = sentencepiece.load(packing.tokenizer_file(sentencepiece.TOKENIZER))
    both = sentencepiece.encode(odd, pieces, back="back")
    assert set(both.columns) == {*odd.columns, "back"}
    apart = sentencepiece.decode(sentencepiece.encode(odd, pieces), pieces, out="back")
    columns = ["doc_id", "text", "ids", "back"]
    assert Counter(str(r) for r in both.select(columns).collect()) == Counter(str(r) for r in apart.select(columns).collect())
    out = sentencepiece.op3_query(spark, "/root/testdata/sf0.001")
    assert all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in out.collect())
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("ArrowEvalPython") == 1


# Pipeline ---------------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, left = left, stage(spark, left, sf_dir)
        assert left.columns == docs.columns and left.join(before, "doc_id", "left_anti").isEmpty()
    ids = {r["doc_id"] for r in left.collect()}
    links = brute_links({r["doc_id"]: r["text"] for r in docs.collect()})
    near = [i for i in ids if links[i][0]]
    assert len({links[i][1] for i in near}) == len(near)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in out} == ids and len(ids) > 0.6 * docs.count()
    assert corpus_pipeline.ORACLE_SQL is None
    assert docs.limit(0).transform(lambda d: corpus_pipeline.STAGES[0][1](spark, d, sf_dir)).count() == 0


def test_most_frequent_grams(spark, monkeypatch):
    """The driver gets no more n-grams than it may, the most frequent ones of each language."""
    monkeypatch.setattr(langid, "MAX_GRAMS", 400)
    rows = [(0, g, 1 + g % 5) for g in range(1000)] + [(1, g, 7) for g in range(30)] + [(2, g, 1) for g in range(5000)]
    got = {i: (last, share) for i, last, share in langid._thresholds(spark.createDataFrame(rows, "id int, gram bigint, n bigint"), 4)}
    assert got[0] == (5, 500_000) and got[1] == (7, 1_000_000) and got[2] == (1, 20_000)
