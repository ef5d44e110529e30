import hashlib
import itertools
import json
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from folioflow.llm import chat, decontaminate, licenses, line_crf, ngram_jaccard, packing, quality_rules, queries, sharding, token_coder, token_files, token_kernel, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, cid string"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    base = [prose(rng, rng.randint(5, 160)) for _ in range(40)]
    texts = list(base)
    for b in base[:25]:
        for _ in range(rng.randint(1, 4)):
            w = b.split()
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    texts += [None, "", "   \n", "one", "One", "ÉÉ b c", base[0], base[0], prose(rng, 6000), "x " * 300]
    passage = prose(rng, 45)
    texts += [prose(rng, k) + " " + passage for k in range(2, 40)]
    texts += [" ".join(rng.choice("ab") for _ in range(400)) for _ in range(6)]  # few words, in all orders
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (3, "other text under a repeated id"), (None, "text without id")]
    return [(i, t, None, f"src{len(t or '') % 3}" if i != 5 else None, None, "clash", "clash") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def test_jaccard_components_match_brute_force(docs, empty):
    rows = corpus()
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    want = Counter((str(r[0]), len(sets[i]), str(least.get(root(i)))) for i, r in enumerate(rows))
    got = Counter((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_jaccard.jaccard_components(docs).collect())
    assert got == want
    assert ngram_jaccard.jaccard_components(empty).count() == 0
    clash = docs.select("*", F.lit(1).alias("gone_id"), F.lit(1).alias("class_mark"), F.lit(1).alias("__class"), F.lit(1).alias("drop_id"))
    assert ngram_jaccard.deduplicated(clash).count() == ngram_jaccard.deduplicated(docs).count()
    kept = ngram_jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    with_set = [r for r in kept.collect() if words(r.text)]
    assert len(with_set) == len({root(i) for i in range(len(rows)) if sets[i]})


def test_block_products_find_what_pairs_find():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64))
    parts = [np.unique(np.where(rng.random(len(base)) < 0.06, rng.integers(0, 1 << 62, len(base), dtype=np.uint64), base)) for _ in range(30)]
    cids = np.arange(30)
    links = ngram_jaccard._block_links(cids, cids, parts, np.ones(30, bool), np.ones(30, bool), 80, 100)
    parent = list(range(30))
    for a, b in links:
        ra, rb = (next(x for x in [k] if True) for k in (a, b))
        group = {parent[ra], parent[rb]}
        parent = [min(group) if p in group else p for p in parent]
    want = list(range(30))
    for a, b in itertools.combinations(range(30), 2):
        common = len(np.intersect1d(parts[a], parts[b]))
        if 100 * common >= 80 * (len(parts[a]) + len(parts[b]) - common):
            group = {want[a], want[b]}
            want = [min(group) if p in group else p for p in want]
    assert parent == want


def test_winnowing_matches_brute_force(spark, docs, empty, monkeypatch):
    rng = random.Random(8)
    rows = corpus()
    items = [(k, " ".join((rows[k][1] or "").split()[3:30]).upper()) for k in range(12)] + [(90, "one"), (91, None), (92, "  "), (93, "ÉÉ b c"), (94, "b c"), (90, "one"), (95, prose(rng, 20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    want = Counter()
    for r in rows:
        w, hit, ids = alnum(r[1]), set(), set()
        for i, t in items:
            v = alnum(t)
            n = min(10, len(v))
            windows = {tuple(v[p : p + n]) for p in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1) if n else ():
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    ids.add(str(i))
        want[str(r[0]), len(w), len(hit), tuple(sorted(ids))] += 1
    got = lambda: Counter((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(docs, bench).collect())
    assert got() == want
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[2])
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 0)  # fingerprints are joined by a shuffle
    assert got() == want
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[2])
    assert decontaminate.contamination(empty, bench).count() == 0


def test_quality_rules_match_brute_force(spark, docs, empty):
    good = spark.createDataFrame([(i,) for i in range(0, 30)], "doc_id long")
    weight = quality_rules.weights(docs, good)
    h = lambda data, seed=42: xxhash.xxh64(data, seed=seed).intdigest()
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def grams(text):
        w = [h(x.encode()) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return [x & 16383 for x in w] + [h(b.to_bytes(8, "little"), h(a.to_bytes(8, "little"))) & 16383 for a, b in zip(w, w[1:], strict=False)]

    raw, target = Counter(), Counter()
    for r in corpus():
        raw.update(grams(r[1]))
        if r[0] is not None and r[0] < 30:
            target.update(grams(r[1]))
    of = lambda n, total: math.log((n + 1) / (total + 16384))
    want = [of(target[b], target.total()) - of(raw[b], raw.total()) for b in range(16384)]
    assert np.allclose(weight, want, atol=1e-6)
    rows = quality_rules.with_quality_rules(docs.withColumn("kept", F.lit("clash")), weight).collect()
    for r in rows:
        text = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        g = grams(text)
        llr = sum(weight[b] for b in g) / len(g) if g else 0.0
        assert abs(r.llr - llr) < 1e-6
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.LEAST)
    repeats = " ".join(f"w{k % 40_000}" for k in range(70_000))
    long = quality_rules.with_quality_rules(spark.createDataFrame([(1, repeats, "h", "p")], "doc_id long, text string, word_h string, pair_h string"), weight).first()
    assert (long.n_words, long.n_repeat_words, long.word_h, long.pair_h) == (70_000, 60_000, "h", "p")
    clashing = docs.withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(None).cast("string"))
    passed = quality_rules.passing(clashing, weight)
    assert passed.columns == clashing.columns
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    assert sorted(map(key, passed.collect())) == sorted(key(r) for r in rows if r.kept)
    assert {(r.kept, r.n_words) for r in passed.collect()} <= {("clash", None)}
    assert quality_rules.passing(empty, weight).count() == 0
    assert quality_rules.weights(empty, good) == [0.0] * quality_rules.BUCKETS
    assert quality_rules.with_quality_rules(empty, weight).count() == 0


def test_crf_marginals_match_enumeration_and_learn(spark, docs, empty):
    p, pairs = [0.3, -1.2, 0.8, 2.0], (0.4, 0.9, -0.7)
    total, good = 0.0, np.zeros(4)
    for y in itertools.product((0, 1), repeat=4):
        s = sum(x for x, v in zip(p, y, strict=True) if v) + sum(pairs[0] if a == b == 0 else pairs[1] if a == b else pairs[2] for a, b in zip(y, y[1:], strict=False))
        total += math.exp(s)
        good += math.exp(s) * np.array(y)
    assert np.allclose(line_crf.chain(p, *pairs), good / total)
    many, _ = line_crf.chains(np.array([p, p]), *pairs)
    assert np.allclose(many[1], good / total)
    rng = random.Random(5)
    rows = [(i, prose(rng, 80) if i % 3 else prose(rng, 40).upper().replace(" ", "!! "), i % 3 and 1) for i in range(300)]
    data = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(y)), 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = line_crf.fit(data, labels)
    out = {r.doc_id: r for r in line_crf.scored(data, model).collect()}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    held = [(out[i].predicted, int(bool(y))) for i, _, y in rows if out[i].held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in line_crf.scored(docs, model).collect())
    assert line_crf.scored(empty, line_crf.fit(empty, labels)).count() == 0
    assert line_crf.good(docs, model).columns == docs.columns
    # one kind of label, or none: no score says anything
    one = labels.where("quality = 1")
    assert {r.score for r in line_crf.scored(docs, line_crf.fit(data, one)).collect()} == {0.5}
    # contradictory labels are bad ones, a repeated id is trained on once, and a text of very many lines not at all
    twice = labels.unionByName(labels.withColumn("quality", F.lit(0)))
    assert {r.score for r in line_crf.scored(docs, line_crf.fit(data, twice)).collect()} == {0.5}
    again = line_crf.fit(data.unionByName(data).unionByName(spark.createDataFrame([(1, "line\n" * 5000)], data.schema)), labels)
    assert np.allclose(again.weights, model.weights)


def test_url_rules_and_vocabulary(spark):
    rows = [(1, "http://A.Example.com/en/7x"), (2, "https://m.example.net/de/8?q"), (3, "http://x.net/de/1"), (4, "http://x.org/es/"), (5, "http://b.com/en/1"), (6, None), (7, "no scheme"), (8, "http://xporn.io/"), (9, "http://porn.io/"), (10, "http://free-casino.io/"), (11, "http://free.io/free"), (12, "http://x.io#/porn"), (12, "http://x.io#/porn")]
    out = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(out[k].rule, out[k].verdict) for k in range(1, 6)] == [("example.com/en/7", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"), ("com/en/", "block")]
    assert [out[k].verdict for k in range(6, 13)] == ["allow", "allow", "allow", "block", "block", "allow", "block"]
    assert (out[6].host, out[7].path, out[1].host) == ("", "", "a.example.com")
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0
    terms = spark.createDataFrame([("Foo", 0.5), ("bar", 0.5), ("foo", 0.25), (None, 1.0), ("", 1.0), ("baz", None)], "term string, weight double")
    own = url_filter.vocabulary_of(terms)
    assert own == {"foo": 0.5, "bar": 0.5}
    clash = spark.createDataFrame([(1, "http://foo.io/bar", "x", "y"), (2, "http://foobar.io/" + "a/" * 200_000 + "foo", "x", "y"), (2, "http://porn.io", "x", "y")], "page_id int, url string, host string, verdict string")
    out = url_filter.judged(clash, vocabulary=own).collect()
    assert sorted((r.page_id, r.terms, r.verdict) for r in out) == [(1, ["bar", "foo"], "block"), (2, [], "allow"), (2, ["foo"], "allow")]


def test_sharding_is_even_and_stable(docs, empty):
    names = [f"s{k}" for k in range(13)]
    table = sharding.lookup_table(names)
    counts = np.bincount(table, minlength=13)
    assert counts.max() - counts.min() <= 1 and (table >= 0).all()
    fewer = sharding.lookup_table(names[:-1])
    moved = np.mean([sorted(names)[a] != sorted(names[:-1])[b] for a, b in zip(table, fewer, strict=True)])
    assert moved < 0.25
    out = sharding.sharded(docs, "doc_id", names[::-1] + names[:2])
    assert out.count() == docs.count() and out.where("shard is null").count() == 0
    assert sharding.sharded(empty, "doc_id", names).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table([])


def test_sharding_matches_brute_force(spark):
    names, size = ["a", "c", "b", "a"], 101
    seeds = {x: hashlib.md5(x.encode()).digest() for x in names}
    table, at = {}, dict.fromkeys(names, 0)
    while len(table) < size:
        for x in sorted(set(names)):
            orders = [(int.from_bytes(seeds[x][:8], "big") + k * (int.from_bytes(seeds[x][8:], "big") % (size - 1) + 1)) % size for k in range(size)]
            free = next((k for k in range(size) if orders[k] not in table), None)
            if free is not None and len(table) < size:
                table[orders[free]] = x
    keys = [None, "", *map(str, range(500)), *["hot"] * 300]
    rows = spark.createDataFrame([(k, "mine", "yours") for k in keys], "key string, slot string, Shard string")
    out = sharding.sharded(rows, "key", names, size)
    assert out.columns == ["key", "slot", "shard"]
    slot = lambda k: int(hashlib.md5((k or "").encode()).hexdigest()[:15], 16) % size
    assert Counter(map(tuple, out.collect())) == Counter((k, slot(k), table[slot(k)]) for k in keys)
    assert [tuple(r) for r in sharding.sharded(rows.where("slot = 'mine'").limit(1), "slot", names, size).select("slot", "shard").collect()] == [(slot("mine"), table[slot("mine")])]


def test_packing_matches_brute_force_and_constraints(docs, empty):
    rng = random.Random(2)
    pieces = sorted(((rng.randint(1, 60), rng.randint(0, 5), rng.randint(0, 40)) for _ in range(300)), key=lambda x: -x[0])
    left, sources, clusters, want = [], [], [], []
    for n, s, c in pieces:
        able = [b for b in range(len(left)) if left[b] >= n and not sources[b] & 1 << s and not clusters[b] & 1 << c]
        b = min(able, key=lambda b: (left[b], b), default=len(left))
        if b == len(left):
            left.append(64), sources.append(0), clusters.append(0)
        want.append((b, 64 - left[b]))
        left[b] -= n
        sources[b] |= 1 << s
        clusters[b] |= 1 << c
    assert packing.pack(pieces, 64) == want
    rows = packing.packed(docs, capacity=128).collect()
    total = Counter()
    for r in rows:
        total[r.bin_id] += r.n_units
    assert all(total[r.bin_id] == r.bin_fill <= 128 for r in rows)
    assert sum(total.values()) == sum(len(words(r[1])) for r in corpus())
    assert packing.packed(empty).count() == 0


def test_packing_keeps_apart_only_equal_values():
    rng = random.Random(6)
    # hashes whose low bits agree, and more sources and clusters than a machine word has bits
    pieces = sorted(((rng.randint(1, 30), rng.randrange(300) << 12, rng.randrange(900) << 12) for _ in range(1500)), key=lambda x: -x[0])
    left, held, want = [], [], []
    for n, s, c in pieces:
        able = [b for b in range(len(left)) if left[b] >= n and ("s", s) not in held[b] and ("c", c) not in held[b]]
        b = min(able, key=lambda b: (left[b], b), default=len(left))
        if b == len(left):
            left.append(2048), held.append(set())
        want.append((b, 2048 - left[b]))
        left[b] -= n
        held[b] |= {("s", s), ("c", c)}
    assert packing.pack(pieces, 2048) == want
    assert len({b for b, _ in packing.pack([(1, k << 12, k << 12) for k in range(2000)], 2048)}) == 1


def test_packing_holds_its_constraints_with_a_third_of_equal_rows(spark, empty):
    rng = random.Random(7)
    rows = [(k, prose(rng, rng.randint(1, 90)), f"src{rng.randrange(9)}") for k in range(400)] + [(7, "the same row again and again", "src1")] * 200
    data = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("id", F.lit("clash"))
    out = packing.packed(data, capacity=64, group_rows=100).collect()
    assert sum(r.n_units for r in out) == sum(len(words(t)) for _, t, _ in rows)
    of = {}
    for i, t, s in rows:
        of.setdefault(i, []).append((t, s))
    bins = {}
    for r in out:
        bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        assert sum(r.n_units for r in members) == members[0].bin_fill <= 64
        sources = [of[r.doc_id][0][1] if r.doc_id != 7 or r.n_units != 6 else "src1" for r in members]
        assert len(sources) == len(set(sources))
        spans = sorted((r.bin_offset, r.bin_offset + r.n_units) for r in members)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sum(r.doc_id == 7 and r.n_units == 6 for r in out) == 200
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", "a")], "doc_id long, text string, source string")
    assert packing.packed(blank).count() == packing.packed(empty).count() == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_packing_keeps_near_copies_apart(spark, tmp_path, repeated):
    rng = random.Random(9)
    rows = []
    for k in range(12):
        w = prose(rng, 80).split()
        for copy in range(3):
            rows.append((len(rows), " ".join(w[:40] + [f"edit{copy}"] + w[41:]), f"src{len(rows)}"))
    group = {t: i // 3 for i, (_, t, _) in enumerate(rows)}
    rows += [(None, "one", "a"), (50, None, "b"), (51, " ", "c"), (52, "one", "d")]
    if repeated:
        rows += [(0, rows[3][1], "e"), (0, rows[3][1], "f"), (None, "two words", "g")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op5_best_fit_packing(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_units) for r in out) == Counter((i, len(words(t))) for i, t, _ in rows if words(t))
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(group.get(t, t))
    if not repeated:
        assert all(n == 1 for n in Counter((r.bin_id, texts[r.doc_id][0]) for r in out).values())
    # three copies of each text, five with the repeated rows, need as many bins
    assert len({r.bin_id for r in out}) == (5 if repeated else 3)


def test_chat_repair_is_cheapest(spark):
    def brute(roles):
        best = math.inf
        legal = [x for n in range(2, 2 * len(roles) + 4) for sys in (0, 1) for x in [["system"] * sys + ["user", "assistant"] * (n // 2)] if n % 2 == 0 and len(x)]
        for target in legal:
            cost = {(0, 0): 0.0}  # turns used, target turns opened
            for i in range(len(roles) + 1):
                for j in range(len(target) + 1):
                    c = cost.get((i, j), math.inf)
                    if c == math.inf:
                        continue
                    if j < len(target):
                        if target[j] != "system":
                            cost[i, j + 1] = min(cost.get((i, j + 1), math.inf), c + 3)
                        if i < len(roles):
                            cost[i + 1, j + 1] = min(cost.get((i + 1, j + 1), math.inf), c + 2 * (roles[i] != target[j]))
                    if i < len(roles) and j:
                        cost[i + 1, j] = min(cost.get((i + 1, j), math.inf), c + 1 + 2 * (roles[i] != target[j - 1]))
            best = min(best, cost.get((len(roles), len(target)), math.inf))
        return best

    rng = random.Random(4)
    for _ in range(60):
        roles = [rng.choice(["user", "assistant", "system", "tool"]) for _ in range(rng.randint(1, 5))]
        costs = chat.forward([0.0] + [chat.INF] * 3, [chat._ROLE.get(r, 0) for r in roles])[-1]
        assert min(c + chat.ending(s)[0] for s, c in enumerate(costs)) == brute(roles)
    rows = [(1, t, rng.choice(["user", "assistant", "system", None]), f"t{t}") for t in range(400)] + [(k, 0, "user", "q") for k in range(2, 30)] + [(None, 1, "user", None), (2, 0, "user", "q")]
    out = chat.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == len(rows)
    whole = Counter()
    for conv in {r.conv_id for r in out}:
        mine = sorted((r for r in out if r.conv_id == conv), key=lambda r: (r.turn, r.role or "", r.text or ""))
        if conv in (2, None):
            continue
        shown = "".join(r.rendered for r in mine)
        heads = re.findall(r"<\|(system|user|assistant)\|>", shown)
        assert heads[-1] == "assistant" and all(a != b for a, b in zip(heads, heads[1:], strict=False)) and "system" not in heads[1:]
        assert shown.count("<|end|>") == len(heads)
        whole[conv] = len(heads)
    roles = [chat._ROLE.get(r[2], 0) for r in sorted(rows[:400], key=lambda r: r[1])]
    end = chat.forward([0.0] + [chat.INF] * 3, roles)[-1]
    best = min(c + chat.ending(s)[0] for s, c in enumerate(end))
    spent = sum({"keep": 0, "merge": 1, "relabel": 2, "relabel+merge": 3}[r.action] + 3 * r.inserted for r in out if r.conv_id == 1)
    assert spent == best
    assert chat.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_numbers_turns_and_escapes_markers(spark):
    text = "a <|end|> b <\\|user|> | c"
    assert chat.unescaped(chat.escaped(text)) == text and "<|" not in chat.escaped(text)
    rows = [(1, 0, ("user", "assistant")[k % 2], f"{text} {k}" if k % 50 else None) for k in range(900)] + [(2, t, "user", "x" * 200_000) for t in range(2)]
    data = spark.createDataFrame([(str(c), str(t), r, x, "clash") for c, t, r, x in rows], "conv_id string, turn string, role string, text string, seq string")
    out = chat.repaired(data.select(F.col("conv_id").cast("decimal(9,0)").alias("conv_id"), F.col("turn").cast("double").alias("turn"), "role", "text", "seq")).collect()
    assert sorted(r.seq for r in out if r.conv_id == 1) == list(range(900))
    mine = sorted((r for r in out if r.conv_id == 1), key=lambda r: r.seq)
    shown = "".join(r.rendered for r in mine)
    parts = re.findall(r"<\|(?:user|assistant|system)\|>\n(.*?)<\|end\|>\n", shown, re.DOTALL)
    assert chat.unescaped("".join(parts)).replace("\n", "") == "".join(r.text or "" for r in mine)


def test_token_blocks_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 70_000, n).astype(np.uint32) for n in (0, 1, 7, 40)] + [np.tile(np.array([5, 9, 5], np.uint32), 30), np.zeros(9, np.uint32)]
    coded = token_coder.encode_blocks(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, token_coder.decode_blocks(coded), strict=True))
    assert len(coded[4]) < 90 * 4 / 3
    damaged = bytearray(coded[3])
    damaged[20] ^= 255
    with pytest.raises(ValueError):
        token_coder.decode_blocks([bytes(damaged)])


def test_token_files_hold_all_ids(spark, tmp_path):
    data = [(5, b"\x01\0\0\0\0\0\0\0"), (1, b"\0\0\0\0"), (3, b"\x07\0\0\0\x09\0\0\0\0\0\0\0"), (None, b"\0\0\0\0"), (3, b"\x07\0\0\0\0\0\0\0")]
    path = str(tmp_path / "tokens")
    token_files.write(spark.createDataFrame([Row(id=i, ids=bytearray(b)) for i, b in data], "id long, ids binary"), path)
    out = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.id for r in out] == [None, 1, 3, 3, 5]
    assert [r.start for r in out] == [0, 1, 2, 4, 7] and [r.n_tokens for r in out] == [1, 1, 2, 3, 2]
    assert all(zlib.crc32(bytes(r.token_ids)) == r.ids_crc32 for r in out)


@pytest.mark.parametrize("kind", ["long", "decimal(20,0)"])
def test_token_query_equals_the_library(spark, tmp_path, kind):
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    rng = random.Random(12)
    texts = [None, "", " \n", "a <|endoftext|> b", "ünïcode 日本 \U0001f600", "x" * 300_000, prose(rng, 9000), *(prose(rng, 30) for _ in range(40))]
    rows = [(int(7919 * k % 101), t) for k, t in enumerate(texts)] + [(500, "equal rows")] * 60 + [(None, "no id")]
    data = spark.createDataFrame([(None if i is None else str(i), t, "clash", "clash") for i, t in rows], "k string, text string, id string, ids string").repartition(5)
    data = data.select(F.col("k").cast(kind).alias("doc_id"), "text", "id", "ids")
    data.write.parquet(str(tmp_path / "documents.parquet"))
    out = sorted(queries.op1_token_files(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    raw = [np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in rows]
    want = Counter((i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, raw, strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    assert [r.start for r in out] == list(itertools.accumulate([0, *(r.n_tokens for r in out)]))[:-1]
    data.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op1_token_files(spark, str(tmp_path / "none")).count() == 0


def test_token_kernel_makes_the_coders_blocks(spark):
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 1 << 32, 5000, dtype=np.uint64), rng.zipf(1.3, 9000) % 50_257, np.array([7]), np.zeros(4096), np.zeros(0)):
        ids = ids.astype("<u4")
        want = token_coder.encode_blocks([ids[k : k + token_coder.BLOCK] for k in range(0, len(ids), token_coder.BLOCK)])
        rows = spark.createDataFrame([Row(raw=bytearray(ids.tobytes()))], "raw binary").select(token_kernel.encode(spark, F.col("raw")).alias("blocks"))
        assert [bytes(b) for b in rows.first().blocks] == want
        assert bytes(rows.select(token_kernel.decode(spark, F.col("blocks"))).first()[0]) == ids.tobytes()
    damaged = bytearray(token_coder.encode_blocks([np.arange(40, dtype=np.uint32)])[0])
    damaged[20] ^= 255
    with pytest.raises(Exception, match="FAILED_EXECUTE_UDF"):
        spark.createDataFrame([Row(blocks=[damaged])], "blocks array<binary>").select(token_kernel.decode(spark, F.col("blocks"))).collect()


def test_words_are_encoded_as_whole_texts_are(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    assert token_files.by_words(model.to_str())
    rng = random.Random(4)
    pieces = [" ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u0085", "\x1c", "\u200b", "a", "Wort", "'s", "'", "12", "é", "日本", "\U0001f600", ".", "<|endoftext|>", "x" * 70]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(6000)] + ["", " ", " a", "a "]
    for as_text in (False, True):
        model.encode_special_tokens = as_text
        monkeypatch.setattr(token_files, "KNOWN", 50 if as_text else 1 << 17)
        words = token_files._Words(model, b"")
        got = [x for k in range(0, len(texts), 100) for x in words.encoded(texts[k : k + 100])]
        assert got == [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]
    changed = json.loads(model.to_str())
    changed["pre_tokenizer"]["add_prefix_space"] = True
    assert not token_files.by_words(json.dumps(changed))


def test_token_blocks_beat_zlib_on_real_ids():
    tokenizers = pytest.importorskip("tokenizers")
    pq = pytest.importorskip("pyarrow.parquet")
    model = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    ids = np.concatenate([np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], np.uint32) for t in texts])
    blocks = [ids[k : k + token_coder.BLOCK] for k in range(0, len(ids), token_coder.BLOCK)]
    coded = token_coder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, token_coder.decode_blocks(coded), strict=True))
    assert sum(map(len, coded)) < 0.92 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)


def test_license_model_knows_families_and_unknown(docs):
    rng = random.Random(1)
    model = licenses.train([prose(rng, 30) for _ in range(200)])
    for family, texts in licenses.TEMPLATES.items():
        assert {h["family"] for t in texts for h in model.scan(t)[1]} == {family}
    assert model.scan(None) == (0, []) and not model.scan("This license plate is released for the public road.")[1]
    assert [h["line"] for h in model.scan("prose\nReleased under the MIT License.\n")[1]] == [1]
    assert licenses.scanned(docs, model).where("license is not null").count() == 0


def test_licenses_are_found_where_planted_and_nowhere_else(spark, empty):
    rng = random.Random(2)
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts]
    family = {t: f for f, ts in licenses.TEMPLATES.items() for t in ts}
    rows, want = [], {}
    for k in range(160):
        body = [prose(rng, 40) for _ in range(rng.randint(1, 6))]
        if k % 4 == 0:
            said = texts[k // 4 % len(texts)]
            body.insert(rng.randrange(len(body) + 1), said)
            want[k] = family[said]
        rows.append((k, "\n".join(body), "clash"))
    rows += [(900, None, "clash"), (901, "", "clash"), (0, rows[0][1], "clash"), (902, "word " * 60_000, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    out = licenses.scanned(docs, licenses.fit(docs)).collect()
    assert len(out) == len(rows) and {r.doc_id: r.license for r in out if r.license} == want
    assert licenses.scanned(empty, licenses.fit(empty)).count() == 0
    # of two families in one text the likelier one counts, by name if they tie
    both = licenses.train([]).scan("Licensed under the MIT License.\nReleased under the MIT License.")[1]
    assert [h["line"] for h in both] == [0, 1]


def test_license_notices_are_found_however_they_are_wrapped():
    rng = random.Random(1)
    model = licenses.train([prose(rng, 30) for _ in range(200)])
    for width, marker in itertools.product((24, 40, 70), ("", "# ", " * ", "// ", "dnl ")):
        for family, texts in licenses.TEMPLATES.items():
            for t in texts:
                if {h["family"] for h in model.scan(t)[1]} != {family}:
                    continue  # a short tag that the classifier does not know on one line either
                lines = textwrap.wrap(t, width)
                body = "\n".join(marker + x for x in [prose(rng, 6), *lines, prose(rng, 6)])
                hits = model.scan("\n".join(["some prose", "", body, "", "more prose"]))[1]
                assert {h["family"] for h in hits} == {family} and 2 <= hits[0]["line"] <= 2 + len(lines), (t, width, marker)
    # pieces of a notice with a blank line or a line of prose between them are no notice
    gpl = textwrap.wrap(licenses.TEMPLATES["GPL"][1], 70)
    assert not model.scan("\n\n".join(gpl))[1] and not model.scan(f"{gpl[0]}\n{prose(rng, 12)}\n{gpl[2]}")[1]


def test_texts_are_cut_where_the_library_cuts_them(spark, tmp_path, monkeypatch):
    """Each distinct piece of a segment is encoded once, and bytes that are not UTF-8 no longer end the query."""
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    rng = random.Random(9)
    pieces = [" ", " ", "\n", "\n", "\t", "\r", " ", " ", "\u0085", "　", "\x1c", "​", "a", "Wort", "'s", "don't", "'", "12", "é", "à", "日本", "\U0001f600", *".,;:!?#*%&$", "%%%", "<|endoftext|>", "x" * 70]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(14))).encode() for _ in range(3000)] + [b"", None, b" ", b"\n", b"a\n\nb", b"\xff\xfe caf\xe9 \xe2\x80 au lait,\xc3\n\xe9"]
    data = spark.createDataFrame([Row(doc_id=k, text=None if t is None else bytearray(t)) for k, t in enumerate(texts)], "doc_id long, text binary")
    data = data.select("doc_id", F.expr("cast(text as string)").alias("text"))
    monkeypatch.setattr(token_files, "TEXTS", 5000)  # many segments
    token_files.write_texts(data, queries.tokenizer_path(), str(tmp_path / "tokens"))
    out = sorted(token_files.read(spark, str(tmp_path / "tokens")).collect(), key=lambda r: r.start)
    want = [np.array([*model.encode((t or b"").decode("utf-8", "replace"), add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    assert [bytes(r.token_ids) for r in out] == want
    cut = spark.createDataFrame([Row(t=bytearray(b"the cat, the cat.\nThe cat"), e=bytearray(np.array([25, 25], "<i4").tobytes()))], "t binary, e binary").select(token_kernel.cut(spark, F.col("t"), F.col("e")))
    found, codes = token_kernel.pieces(bytes(cut.first()[0]))
    assert found == [b"the", b" cat", b",", b" the", b".", b"\n", b"The"] and codes.tolist() == [1, 2, 3, 4, 2, 5, 6, 7, 2, 0, 0]


def test_parts_of_a_mixture_fit_sixteen_bits():
    lanes, rng = token_coder._Lanes(1, 4), np.random.default_rng(1)
    most = 0
    for ids in (rng.zipf(1.5, 1500) % 50_257, np.full(1500, 40_000), rng.integers(0, 1 << 16, 500)):
        for i in ids.tolist():
            lanes.begin(1)
            for place in range(4):
                most = max(most, int(lanes.predict(place)[1][0, -1]))
                lanes.update(np.array([i >> 12 - 4 * place & 15]))
            lanes.end(np.array([i]))
    assert most < 1 << 16
