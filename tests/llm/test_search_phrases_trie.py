"""Nearest neighbours, phrases and the conversation trie against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.llm import one_bit_search, phrases, prefix_trie

# conversation trie


def brute_trie(rows, group=20):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(xs)] for c, xs in own.items()}
    made = {}
    for c, xs in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - int(math.fmod(c, group)), [])[:h] + xs[h:]
    members, ends = {}, {}
    for c, xs in made.items():
        for d in range(len(xs) + 1):
            members.setdefault(tuple(xs[:d]), []).append(c)
        ends.setdefault(tuple(xs), []).append(c)
    out = set()
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = lambda p: sum(len(q) == len(p) + 1 and q[:-1] == p for q in below)
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        up = min(members[path[:-1]]) if path else None
        out.add((min(who), len(path), up, len(who), kids(path), sum(kids(p) == 0 for p in below), sum((len(members[p]) - 1) * words(p) for p in below), digest))
    return out


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows():
    rng = np.random.default_rng(3)
    rows = []
    for c in [*range(0, 12), *range(20, 33), 45, 47, -3, -20, -21, 61, 62, 63]:
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, None if t == 0 and c % 3 == 0 else t, ["user", "assistant", None][int(rng.integers(0, 3))], ["a b", "c", "", None, "d\te\x0bf", "x y z"][int(rng.integers(0, 6))]))
    rows += [(0, 1, "user", "tie"), (0, 1, "user", "tie"), (20, 2, "b", "x"), (20, 2, "a", "x"), (None, 1, "user", "of none"), (None, None, None, None)]
    for c in (101, 102, 103, 104):  # no conversation 100 or 120
        rows += [(c, t, "user", "same words here") for t in range(c - 97)]
    return rows


def test_trie_equals_brute_force(spark, monkeypatch):
    rows = trie_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("x"), "k1": F.lit(1), "part": F.lit(2)}).repartition(5)
    count = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    made = prefix_trie.prefixes
    monkeypatch.setattr(prefix_trie, "prefixes", lambda turns: made(turns, block=2))  # a conversation spans several blocks
    got = prefix_trie.prefix_trie(df, 20, count, most=3).collect()
    assert len(got) == len({(r.conv_id, r.depth) for r in got})
    assert {tuple(r[c] for c in TRIE) for r in got} == brute_trie(rows)


def test_trie_of_a_long_conversation_and_its_copies(spark):
    rows = [(c, t, "user", f"w{t}") for c in (0, 1, 2) for t in range(1100 + (c == 2))]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 20, F.lit(0), most=0)
    by = {(r.conv_id, r.depth): r for r in got.collect()}
    assert len(by) == 1102 and by[0, 0].n_convs == 3 and by[0, 0].saved_tokens == 2 * 1100 and by[2, 1101].n_convs == 1
    assert by[0, 700].saved_tokens == 2 * 401 and by[0, 1100].n_children == 1 and by[0, 1100].ends_sha256 == hashlib.sha256(b"0,1").hexdigest()


def test_trie_of_nothing_is_empty(spark):
    got = prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), 20, F.lit(1), most=3)
    assert got.columns == TRIE and got.count() == 0


def test_digests_join_ranges_in_order(spark):
    ids = [-40, -7, 0, 3, 9, 10, 11, 99, 100, 1000]
    ends = spark.createDataFrame([(1, 2, 3, i) for i in reversed(ids)] + [(1, 2, 4, 5)], "depth long, k1 long, k2 long, conv_id long")
    got = {(r.k1, r.k2): r.ends_sha256 for r in prefix_trie.end_digests(ends, span=8).collect()}
    assert got == {(2, 3): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (2, 4): hashlib.sha256(b"5").hexdigest()}


# phrases


def brute_phrases(docs, least, top):
    counts, totals = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = set()
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and b >= a and inside(p, q) for q, b in found.items()):
                continue
            score, _, left, right = min((1000 * a * totals[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def phrase_docs():
    rng = np.random.default_rng(11)
    words = ["the", "of", "New", "york", "city", "é", "ÄB", "x|y", "long", "tail"]
    docs = [(["en", "de", None, "und", ""][int(rng.integers(0, 5))], "".join(words[int(i)] + [" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ? "][int(rng.integers(0, 9))] for i in rng.zipf(1.4, int(rng.integers(0, 60))) % 10)) for _ in range(150)]
    return docs + [("en", None), ("en", ""), (None, None), ("en", " \t"), ("en", "a a a a a a a a a"), ("en", "the quick brown fox jumps over it. " * 40), ("one", "word"), ("en", "y" * 50_000 + " z")] * 2


@pytest.mark.parametrize("least,top,hot,bucket", [(3, 2000, 20_000, 200_000), (5, 7, 10, 40)])
def test_phrases_equal_brute_force(spark, least, top, hot, bucket, monkeypatch):
    docs = phrase_docs()
    df = spark.createDataFrame(docs, "lang string, text string").withColumns({"word": F.lit("q"), "n": F.lit(1), "words": F.lit("z")}).repartition(3)
    made = phrases.frequent_phrases
    monkeypatch.setattr(phrases, "frequent_phrases", lambda d, x, h: made(d, x, h, bucket))
    got = phrases.collocations(df, least, top, hot).collect()
    want = brute_phrases(docs, least, top)
    assert len(want) > 10 and {tuple(r) for r in got} == want and len(got) == len(want)


def test_phrases_of_nothing_are_none(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "a b")], "lang string, text string")).count() == 0


def test_scores_are_exact_past_64_bits(spark, monkeypatch):
    """Counts as of a table of 10^13 words."""
    words = spark.createDataFrame([(1, "en", "p", 3 * 10**12, 10**13), (2, "en", "q", 2 * 10**12 + 1, 10**13)], "word long, lang string, form string, n long, total long")
    found = spark.createDataFrame([([1, 2], 1_999_999_999_999)], "words array<long>, a long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: (words, found))
    r = phrases.collocations(words).first()
    assert r.score == 1000 * r.a * r.n // (r.l * r.r) == 1000 * 1_999_999_999_999 * 10**13 // (3 * 10**12 * (2 * 10**12 + 1))


def test_summed_adds_equal_rows():
    columns, counts = phrases.summed([np.array([2, 1, 2, 2], dtype=np.uint64), np.array([9, 9, 9, 8], dtype=np.uint64)], np.array([1, 2, 3, 4]))
    assert [c.tolist() for c in columns] == [[1, 2, 2], [9, 8, 9]] and counts.tolist() == [2, 4, 4]


# nearest neighbours


def brute_nearest(rows, k, wanted):
    best = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            best[i] = min(best.get(i, v), v)
    dot = lambda a, b: reduce(lambda t, xy: t + xy[0] * xy[1], zip(a, b, strict=True), 0.0)  # noqa: E731  sum() would compensate
    out = set()
    for q in filter(wanted, best):
        near = sorted((-dot(best[q], v), i) for i, v in best.items() if i != q and len(v) == len(best[q]))[:k]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(near, 1)}
    return out


def vectors():
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(12).astype(np.float32)]) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # copies, some of them queries
    rows += [(2000 + i, [1.0, 0.0, float(i % 2)]) for i in range(9)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 12), (3003, [float("nan")] * 12), (3004, [float("inf"), *[1.0] * 11]), (3005, [None, *[1.0] * 11]), (None, [1.0] * 12), (20, rows[20][1]), (40, [9.0] * 12), (3006, [1e-300] * 12), (3007, [1e100] * 12)]
    return rows


@pytest.mark.parametrize("block,rows_a_list", [(16_384, 65_536), (40, 50)])
def test_neighbours_equal_brute_force(spark, block, rows_a_list):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rep": F.lit(1), "score": F.lit("s"), "v": F.lit(0), "id": F.lit(0)}).repartition(4)
    got = one_bit_search.nearest_neighbours(df, df.where(F.col("vec_id") % 20 == 0), k=5, epsilon=4.0, block=block, query_block=7, rows_a_list=rows_a_list, sample=200).collect()
    want = brute_nearest(rows, 5, lambda i: i % 20 == 0)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_neighbours_of_nothing_are_none(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert one_bit_search.nearest_neighbours(empty, empty).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert one_bit_search.nearest_neighbours(one, one).count() == 0


def test_recall_of_the_query_and_its_exact_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    got = one_bit_search.op11(spark, sf).toPandas()
    v = np.array(rows["embedding"].tolist(), dtype=np.float64)
    ids = rows["vec_id"].to_numpy()
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = v @ v[q]
        score[q] = -np.inf
        best = set(ids[np.argsort(-score)[:20]].tolist())
        mine = got[got["query_id"] == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and (np.diff(mine["score"]) <= 0).all()
        hits += len(best & set(mine["vec_id"]))
    assert hits >= 0.99 * len(got)


def test_estimates_keep_their_bound():
    rng = np.random.default_rng(1)
    v, q = rng.standard_normal((500, 64)), rng.standard_normal((40, 64))
    index = one_bit_search.Index({64: np.zeros((1, 64))})
    _, bits, scale, spread, _ = index.code(v)
    signs = np.unpackbits(bits, axis=1, count=64) * 2.0 - 1
    wrong = (q @ index.rotation(64).T @ signs.T) * scale - q @ v.T
    errors = spread * np.sqrt((q * q).sum(axis=1))[:, None]
    assert np.mean(np.abs(wrong) > 2.5 * errors) < 0.02 and 0.9 < np.std(wrong / errors) < 1.1
