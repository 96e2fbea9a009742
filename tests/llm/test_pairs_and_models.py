"""Similarity joins, fingerprints, pieces, shards, trees and the class model."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.llm import class_lm, components, fingerprints, ngram_join, pieces, reply_trees, sharding
from tidegate.llm.common import hashed_words, id_filter


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def near_texts():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefg"), 4))
    texts = [None, "", " \t", "one", "one", "one two", "ONE two"]
    for n in (4, 12, 40, 150):
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for k in (0, 1, 1, 2, 3, 5, 9, 16, 30):
            own = list(base)
            for at in rng.integers(0, n, min(k, n)):
                own[at] = word()
            texts.append(" ".join(own))
        texts.append(" ".join(base + [word() for _ in range(n // 10 + 1)]))
    return texts


def brute_components(texts, size, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("size,num,den,parts,spare", [(3, 90, 100, 3, 1), (5, 80, 100, 1, 0), (3, 60, 100, 4, 2)])
def test_join_equals_brute_force(spark, size, num, den, parts, spare):
    texts = near_texts()
    df = table(spark, texts).withColumn("class", F.lit("x")).withColumn("n", F.lit(0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(df, size=size, similarity=(num, den), parts=parts, spare=spare, filter_bits=1 << 12).collect()}
    assert got == brute_components(texts, size, num, den)


def test_signatures_meet_whenever_sets_are_similar():
    rng = np.random.default_rng(1)
    for num, parts, spare in ((90, 3, 1), (80, 1, 0)):
        bands = ngram_join.Bands(num, 100, parts, spare)
        for n in [*range(1, 60), 200, 500]:
            for _ in range(4):
                a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
                for drop in range(n + 1):
                    add = rng.integers(0, n // 5 + 1)
                    b = np.unique(np.concatenate([rng.permutation(a)[: len(a) - drop], rng.integers(0, 2**63, add, dtype=np.uint64)]))
                    common = len(np.intersect1d(a, b))
                    if 100 * common < num * (len(a) + len(b) - common):
                        break
                    assert len(np.intersect1d(bands.signatures(a), bands.signatures(b)))


def test_join_of_repeated_rows_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    got = ngram_join.join_components(table(spark, [long, long + " end", "a b c d e f"]).union(table(spark, [long])), filter_bits=1 << 12).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (0, 0), (1, 0), (2, 2)]


def test_one_of_each_keeps_the_smallest(spark):
    texts = ["a b c d e f g h", "a b c d e f g h", "z y x w v u", None]
    kept = ngram_join.one_of_each(table(spark, texts), filter_bits=1 << 10)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    assert ngram_join.one_of_each(table(spark, []), filter_bits=1 << 10).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 101), (100, 100), (101, 100)], "a long, b long"))
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_id_filter_never_misses(spark):
    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    may = id_filter(ids, "k", 1 << 10)
    assert ids.where(may(F.col("k"))).count() == 1000


def test_word_hashes_follow_bytes():
    texts = [b"a bb  a\n", b"", b" \t", b"bb", ("é" * 70000).encode() + b" a"]
    hashes, counts, *_ = hashed_words(texts)
    assert counts.tolist() == [3, 0, 0, 1, 2] and hashes[0] == hashes[2] == hashes[5] and hashes[1] == hashes[3] != hashes[0]


def test_fingerprints_estimate_similarity(spark):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 200, 400)]
    texts = [" ".join(base), " ".join(base[:300] + [f"v{i}" for i in range(100)]), None, " ", "solo", " ".join(base)]
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(table(spark, texts), samples=256).collect()}
    assert got[0] == got[5] and got[2] == got[3] == fingerprints.empty_fingerprint(256) != got[4]
    a, b = Counter(base), Counter(base[:300] + [f"v{i}" for i in range(100)])
    truth = sum((a & b).values()) / sum((a | b).values())
    equal = sum(got[0][i : i + 8] == got[1][i : i + 8] for i in range(0, 2048, 8)) / 256
    assert abs(equal - truth) < 0.13
    assert fingerprints.fingerprints(table(spark, [])).count() == 0


def test_fingerprint_query_on_odd_tables(spark, tmp_path):
    def run(name, rows):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
        return {r.doc_id: r for r in fingerprints.op5(spark, str(tmp_path / name)).collect()}

    one = run("one", [(7, "a b c d")])[7]  # its own next document
    assert one.n_chars == 7 and one.near_next == 1.0
    long = "word " * 100_000 + "end"
    got = run("some", [(1, None), (2, ""), (3, long), (4, long), (5, "é🙂" * 8)])
    assert got[3].fingerprint == got[4].fingerprint and got[3].near_next == 1.0 and got[1].fingerprint == got[2].fingerprint and got[5].n_chars == 16
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    for r in got.values():  # likeness is the share of equal samples
        same = [r.fingerprint[i : i + 8] == r.edited_fingerprint[i : i + 8] for i in range(0, len(r.fingerprint), 8)]
        assert abs(r.near_edited - sum(same) / len(same)) < 1e-9
    assert run("none", []) == {}


def test_next_in_order_closes_the_ring(spark):
    ids = spark.createDataFrame([(i,) for i in (5, -3, 99, 7, 12, 40)], "doc_id long")
    got = {r.doc_id: r.next_id for r in fingerprints.next_in_order(ids, "doc_id", rows_per_part=2).collect()}
    assert got == {-3: 5, 5: 7, 7: 12, 12: 40, 40: 99, 99: -3}


def test_edited_texts_by_hand(spark, sf_dir):
    import hashlib

    rows = {r.doc_id: r for r in fingerprints.op5(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    order = sorted(texts)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        q = len(texts[a]) // 4
        edited = texts[a][: len(texts[a]) - q] + texts[b][:q]
        assert rows[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[a].n_chars == len(texts[a])
    assert np.mean([r.near_edited for r in rows.values()]) > 3 * np.mean([r.near_next for r in rows.values()])


def brute_path(p, chunk):
    score = {t: s for t, s in zip(p.texts, p.scores, strict=True) if t}
    best = [(0.0, 0)]
    for end in range(1, len(chunk) + 1):
        top = (-math.inf, 0)
        for n in range(min(end, p.longest), 0, -1):
            s = score.get(chunk[end - n : end], p.unknown if n == 1 else None)
            if s is not None and best[end - n][0] + s > top[0]:
                top = (best[end - n][0] + s, n)
        best.append(top)
    out, end = [], len(chunk)
    while end:
        out.append(chunk[end - best[end][1] : end])
        end -= best[end][1]
    return out[::-1]


def test_pieces_take_the_best_path_and_come_back(spark):
    p = pieces.Pieces.load(pieces.default_model())
    own = pieces.Encoder(p)
    texts = ["", None, " ", "  two  spaces ", "plain words here", "日本語 🙂\ttab\n\nx", "a▁b ▁", "x" * 200, "Über straße", "same", "same"]
    ids = own.encode(texts)
    assert [own.decode(x) for x in ids] == [t or "" for t in texts]
    for chunk in ("▁plain", "▁strasse", "▁▁two", "▁Übermut", "▁x" + "y" * 30):
        want = [i for t in brute_path(p, chunk) for i in ([p.texts.index(t)] if t in p.texts else p.bytes_[list(t.encode())].tolist())]
        assert p.best_paths([chunk, chunk])[1].tolist() == want
    df = table(spark, texts).withColumn("ids", F.lit("clash"))
    rows = {r.doc_id: r for r in pieces.encoded(df).withColumn("back", pieces.decoded(F.col("ids"))).collect()}
    assert all(rows[i].back == (t or "") for i, t in enumerate(texts))
    assert pieces.encoded(table(spark, [])).count() == 0


@pytest.mark.parametrize("kind", ["cjk", "base64", "mixed", "one letter"])
def test_long_texts_without_spaces(kind):
    import time

    rng = np.random.default_rng(6)
    signs = {"cjk": [chr(0x4E00 + i) for i in range(900)], "base64": list("ABCDEFabcdefghijklmnopqrstuvwxyz0123456789+/"), "mixed": list("abcdé日本🙂\n"), "one letter": ["a"]}[kind]
    text = "".join(rng.choice(signs, 100_000))
    p = pieces.Pieces.load(pieces.default_model())
    own = pieces.Encoder(p)
    began = time.monotonic()
    (ids,) = own.encode([text])
    assert time.monotonic() - began < 2
    at = {t: i for i, t in enumerate(p.texts) if t}
    assert ids.tolist() == [i for t in brute_path(p, pieces.MARK + text) for i in ([at[t]] if t in at else p.bytes_[list(t.encode())].tolist())]
    assert own.decode(ids) == text
    for part in (text[:33], text[:400]):
        assert p.best_paths([part])[0].tolist() == p.path_by_matches(part).tolist() == p.path_by_matches(part, block=7).tolist()


def test_piece_query_against_brute_force(spark, sf_dir):
    p = pieces.Pieces.load(pieces.default_model())
    at = {t: i for i, t in enumerate(p.texts) if t}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    known = {}

    def ids_of(chunk):
        if chunk not in known:
            known[chunk] = [i for t in brute_path(p, chunk) for i in ([at[t]] if t in at else p.bytes_[list(t.encode())].tolist())]
        return known[chunk]

    for r in pieces.op6(spark, sf_dir).collect():
        text = texts[r.doc_id]
        assert pieces.MARK not in (text or "")
        ids = [i for c in pieces._CHUNK.findall(pieces.MARK + text.replace(" ", pieces.MARK)) for i in ids_of(c)] if text else []
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))


def test_piece_query_round_trip(spark, sf_dir):
    got = pieces.op6(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    assert got and all(r.decoded_crc32 == zlib.crc32((r.text or "").encode()) for r in got)


def test_shards(spark):
    rows = [(i, "hot " * 9 if i % 3 == 0 else None if i % 50 == 1 else f"text {i} " * (i % 11)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x"))
    got = sharding.shard_by_bytes(df, shards=4, bytes_per_cell=1500).select("doc_id", "shard", "slot", sharding.text_size("text").alias("size")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert sorted(r.doc_id for r in got) == list(range(900)) and len(by) == 4
    sizes = [sum(r.size for r in x) for x in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    for x in by.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    assert sharding.shard_by_bytes(df.limit(0), 4).count() == 0


def test_equal_texts_share_a_shard_unless_too_large(spark):
    rows = [(i, f"copy {i // 5} " * (i // 5 % 4)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tolerance, whole in ((0.01, True), (0.0, False)):
        got = sharding.shard_by_bytes(df, shards=8, group_tolerance=tolerance).where("text <> ''").groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count()
        assert (got == 0) == whole
    hot = spark.createDataFrame([(i, "hot " * 20 if i % 2 else f"text {i}") for i in range(2000)], "doc_id long, text string")
    sizes = [r["sum(size)"] for r in sharding.shard_by_bytes(hot, shards=8).withColumn("size", sharding.text_size("text")).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.03 * max(sizes)


def test_slots_of_repeated_rows_and_long_texts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, None), (2, "x" * 2_000_000)], "doc_id long, text string")
    got = sharding.shard_by_bytes(df, shards=2, bytes_per_cell=500_000).collect()
    assert len(got) == 5
    for shard in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))


def test_shards_of_the_documents(spark, sf_dir):
    rows = sharding.op4(spark, sf_dir).collect()
    by = defaultdict(int)
    for r in rows:
        by[r.shard] += r["size"]
    mean, largest = sum(by.values()) / 16, max(r["size"] for r in rows)
    assert max(abs(x - mean) for x in by.values()) <= 0.02 * mean + 2 * largest
    home = defaultdict(set)
    for r in rows:
        home[r.text_crc32, r["size"]].add(r.shard)
    weight = Counter()
    for r in rows:
        weight[r.text_crc32, r["size"]] += r["size"]
    assert all(weight[k] > 0.01 * mean for k, x in home.items() if len(x) > 1)


def test_trees(spark):
    rows = [(1, 1, None, 1.0, "user", "q"), (1, 2, 1, 0.5, "assistant", "a <|im_end|>\\n"), (1, 3, 1, 0.9, "assistant", "b"), (1, 4, 2, 1.0, "user", None), (1, 5, 4, 0.0, "assistant", "z\\s|<"), (2, 1, 9, None, "sys\ntem<|", "t"), (3, 1, 2, 1.0, "user", "c"), (3, 2, 1, 1.0, "user", "c"), (None, 1, None, 0.0, None, "n")]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string").withColumn("path", F.lit("clash"))
    found = reply_trees.format_trees(nodes, 2).select("tree", "path", reply_trees.turns_of(F.col("text")).alias("t"), reply_trees.loss_texts(F.col("text"), F.col("loss")).alias("l")).collect()
    got = {(r.tree, r.path): ([(t.role, t.text) for t in r.t], list(r.l)) for r in found}
    assert got[1, 5] == ([("user", "q"), ("assistant", "a <|im_end|>\\n"), ("user", ""), ("assistant", "z\\s|<")], ["a <|im_end|>\\n", "z\\s|<"])
    assert got[1, 3] == ([("user", "q"), ("assistant", "b")], ["b"]) and got[2, 1] == ([("sys\ntem<|", "t")], [])
    assert got[None, 1] == ([("", "n")], []) and not any(t == 3 for t, _ in got)  # tree 3 is a cycle
    best = reply_trees.best_paths(nodes, 1).where("tree = 1").select("path").distinct().collect()
    assert [r.path for r in best] == [5]
    assert reply_trees.format_trees(nodes.limit(0)).count() == 0


def test_trees_of_ties_repeats_and_long_texts(spark):
    long = "x<|im_end|>" * 50_000
    rows = [(1, 1, None, 1.0, "user", long), (1, 3, 1, 0.5, "assistant", "b"), (1, 2, 1, 0.5, "assistant", "a")]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    assert [r.path for r in reply_trees.best_paths(nodes, 1).select("path").distinct().collect()] == [2]  # the smaller id of equal leaves
    got = reply_trees.format_trees(nodes, 1).select(reply_trees.turns_of(F.col("text")).alias("t")).first().t
    assert [x.text for x in got] == [long, "a"]


def test_exchange_gain_is_the_likelihood_difference():
    rng = np.random.default_rng(0)
    words, clusters = 12, 3
    big = rng.integers(0, 9, (words + 2, words + 2)).astype(float)
    classes = np.concatenate([np.arange(words) % clusters, [clusters, clusters + 1]])

    def matrix(c):
        m = np.zeros((clusters + 2, clusters + 2))
        np.add.at(m, (c[:, None].repeat(words + 2, 1), c[None].repeat(words + 2, 0)), big)
        return m

    m = matrix(classes)
    for w in range(words):
        right = np.bincount(np.delete(classes, w), np.delete(big[w], w), clusters + 2)
        left = np.bincount(np.delete(classes, w), np.delete(big[:, w], w), clusters + 2)
        now, gain = class_lm.best_move(m, classes[w], right, left, big[w, w], clusters)
        tried = []
        for k in range(clusters):
            moved = classes.copy()
            moved[w] = k
            tried.append(class_lm.likelihood(matrix(moved)) - class_lm.likelihood(m))
        assert abs(max(0.0, max(tried)) - gain) < 1e-6 and abs(tried[now] - gain) < 1e-6


def test_class_model_scores(spark, sf_dir):
    got = {r.doc_id: r for r in class_lm.op8(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    split = {i: (t or "").encode().lower().split() + [None] for i, t in texts.items()}
    c = Counter(w for i, ws in split.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in split.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert abs(got[i].base_score - base) < 1e-6 * max(1, abs(base)) and got[i].n_known == sum(c[w] > 0 for w in ws) and got[i].n_tokens == len(ws)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def brute_scores(texts, train, classes, clusters, strength=5.0):
    """The model's score of each text, in plain Python, from the words' classes alone."""
    split = lambda t: (t or "").encode().lower().split()
    n = Counter(w for t in train for w in split(t))
    tokens, once = sum(n.values()) + len(train), sum(c == 1 for c in n.values()) + (len(train) == 1)
    cls = lambda w: classes[w] if w in n else clusters
    end, total = clusters + 1, clusters + 2
    m, mass = np.zeros((total, total)), np.ones(total)
    for t in train:
        path = [end, *(cls(w) for w in split(t)), end]
        for a, z in zip(path, path[1:], strict=False):
            m[a, z] += 1
    share = (m.sum(axis=0) + 0.1) * (np.arange(total) != clusters)
    share /= share.sum()
    unseen = (once + 0.5) / (tokens + 1)
    step = (1 - unseen) * (m + strength * share) / (m.sum(axis=1, keepdims=True) + strength)
    step[:, clusters] = unseen
    assert np.allclose(step.sum(axis=1), 1)
    for c in range(clusters):
        mass[c] = sum(k for w, k in n.items() if cls(w) == c) or 1
    mass[clusters] = once + 1
    found = []
    for t in texts:
        ws = split(t)
        path = [end, *map(cls, ws), end]
        found.append(sum(math.log10(step[a, z]) for a, z in zip(path, path[1:], strict=False)) + sum(math.log10(max(1, n[w]) / mass[cls(w)]) for w in ws))
    return found


@pytest.mark.parametrize("heads,frequent", [(6, 9), (6, 4000), (0, 0), (4000, 3)])
def test_class_scores_equal_brute_force(spark, heads, frequent):
    rng = np.random.default_rng(3)
    word = lambda: f"w{int(rng.zipf(1.4)) % 60}"
    train = [" ".join(word() for _ in range(int(rng.integers(0, 40)))) for _ in range(60)]
    texts = [*train[:20], "W1 w2 nie w3 nie nie", None, "", train[3], train[3], "x " * 3000]
    model, vocabulary = class_lm.train(table(spark, train), heads=heads, frequent=frequent, clusters=4)
    rows = {r.word: r for r in vocabulary.collect()}
    names = sorted({w for t in train for w in t.split()})
    hashes = dict(zip(names, hashed_words([w.encode() for w in names])[0].view(np.int64).tolist(), strict=True))
    assert set(rows) == set(hashes.values()) and all(0 <= r["class"] < 4 for r in rows.values())
    classes = {w.encode(): rows[h]["class"] for w, h in hashes.items()}
    got = {r.doc_id: r.score for r in class_lm.score(table(spark, texts), model, vocabulary).collect()}
    for i, want in enumerate(brute_scores(texts, train, classes, 4)):
        assert abs(got[i] - want) < 1e-6 * max(1, abs(want))


def test_rare_words_join_their_like(spark):
    rng = np.random.default_rng(4)
    train = [" ".join(f"{'ab'[(i + j) % 2]}{rng.integers(0, 8)}" for j in range(30)) for i in range(200)] + ["a1 rareb a2", "b1 rarea b2", "a3 rareb a4", "b5 rarea b5"]
    _, vocabulary = class_lm.train(table(spark, train), heads=16, frequent=16, clusters=2)
    cls = {r.word: r["class"] for r in vocabulary.collect()}
    of = lambda w: cls[int(hashed_words([w.encode()])[0].view(np.int64)[0])]
    assert {of(f"a{i}") for i in range(8)} == {of("rarea")} != {of(f"b{i}") for i in range(8)} == {of("rareb")}


def test_rows_that_share_a_key_are_scored_apart(spark):
    model, words = class_lm.train(table(spark, ["a b a b a", "b a b"]), heads=2, frequent=2, clusters=2)
    rows = spark.createDataFrame([(1, "a"), (1, "b b"), (1, "b b"), (None, "zz")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in class_lm.score(rows, model, words).collect())
    assert got == [(0, 2, 1), (1, 2, 2), (1, 3, 3), (1, 3, 3)]


def test_class_model_edges(spark):
    train = table(spark, ["a b a b a", "b a b", None])
    model, words = class_lm.train(train, heads=1, frequent=1, clusters=2)
    got = {r.doc_id: r for r in class_lm.score(table(spark, [None, "", "a", "zz yy zz", "A b"]).withColumn("word", F.lit(1)), model, words).collect()}
    assert got[0].n_tokens == got[1].n_tokens == 1 and got[0].score == got[1].score and got[3].n_known == 1 and got[4].n_known == 3
    assert all(r.score < 0 and r.base_score < 0 for r in got.values())
    empty, none = class_lm.train(table(spark, []), heads=4, frequent=4, clusters=2)
    assert class_lm.score(table(spark, ["a"]), empty, none).first().n_known == 0
    assert class_lm.score(table(spark, []), model, words).count() == 0


def test_signatures_are_short_and_wide_bitmaps_spare_only_unlike_sets(spark):
    """signatures keep 40 bits; a pair's wide bitmaps, of one size or of two, never turn down a similar pair and do turn down unlike ones."""
    sigs = [np.array([2**64 - 1, 5], dtype=np.uint64)]
    assert max(ngram_join._pairs(sigs, [np.array([1, 1])]).column(0).to_pylist()) < 2**40
    draw = np.random.default_rng(3)
    digest, pairs, similar = [], [], set()
    for i, n in enumerate([200, 257, 500, 515, 1000, 1030, 4000] * 6):
        x = draw.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[: n - (i * n // 50)], draw.integers(0, 2**63, i * n // 100, dtype=np.uint64)])
        for k, s in ((2 * i, x), (2 * i + 1, y)):
            wide = ngram_join.wide_bits(s)
            digest.append((k, len(s), None if wide is None else wide.tolist()))
        pairs.append((2 * i, 2 * i + 1))
        if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)):
            similar.add((2 * i, 2 * i + 1))
    digest = spark.createDataFrame(digest, "doc_id long, n long, wide array<long>")
    got = set(map(tuple, ngram_join._likely(spark.createDataFrame(pairs, "a long, b long"), digest, 80, 100).collect()))
    assert similar <= got and 0 < len(similar) and len(got) < len(pairs) - 15
