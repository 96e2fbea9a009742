"""Fingerprints and shards of the given documents, worked out again in plain Python from the stated hashes."""

import math
import re
import struct
from collections import Counter

import pytest
import xxhash

from tidegate.llm import fingerprints, sharding
from tidegate.llm.common import SPACE

LOW = (1 << 32) - 1


def hashed(*values):
    """Spark's xxhash64 of columns: each value's hash seeds the next one's; an int has four bytes, (x, 8) eight."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v)
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed


def long(x):
    return (x - (1 << 64) if x >= 1 << 63 else x, 8)


def plain_fingerprint(text, samples):
    """The sample of each round: the word of the smallest c / (y e^r) with its t, by the module's formulas."""
    weights = Counter(re.findall(f"[^{SPACE}]+", text))
    unit = lambda h, shift, bits: ((h >> shift & (1 << bits) - 1) + 0.5) / (1 << bits)
    out = []
    for rank in range(samples):
        keys = []
        for word, weight in weights.items():
            w = hashed(word)
            one = hashed(long(w), rank)
            two = hashed(rank, long(one))
            r = -math.log(unit(one, 32, 32) * unit(one, 0, 32))
            c = -math.log(unit(two, 43, 21) * unit(two, 22, 21))
            b = unit(two, 0, 22)
            t = math.floor(math.log(weight) / r + b)
            keys.append((c / (math.exp(r * (t - b)) * math.exp(r)), hashed(long(w), (t, 8)) & LOW))
        out.append(f"{min(keys)[1]:08x}" if keys else "0" * 8)
    return "".join(out)


def test_fingerprints_by_plain_python(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = {r.doc_id: r for r in fingerprints.op5(spark, sf_dir).collect()}
    order = sorted(texts)
    equal = n = 0
    for at, i in list(enumerate(order))[::3]:
        if len(texts[i]) > 20_000:
            continue  # plain Python is slow; long texts take the same path
        q = len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - q] + texts[order[(at + 1) % len(order)]][:q]
        for text, got in ((texts[i], rows[i].fingerprint), (edited, rows[i].edited_fingerprint)):
            want = plain_fingerprint(text, fingerprints.SAMPLES)
            equal += sum(want[j : j + 8] == got[j : j + 8] for j in range(0, len(want), 8))
            n += fingerprints.SAMPLES
    assert n > 3000 and equal >= 0.999 * n  # keys are compared in steps of 2**-24, and logarithms may differ in their last bit


@pytest.mark.parametrize("shards, bytes_per_cell", [(16, 1 << 27), (5, 40_000)])
def test_shards_by_a_plain_sort(spark, sf_dir, shards, bytes_per_cell):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = sorted((hashed(r.text or ""), hashed(1, (r.doc_id, 8)), r.doc_id, len((r.text or "").encode()) + 1) for r in docs.collect())
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_by_bytes(docs, shards, bytes_per_cell=bytes_per_cell).select("doc_id", "shard", "slot").collect()}
    placed = [got[i] for _, _, i, _ in held]
    assert len(got) == len(held) and placed == sorted(placed)  # one after the other in the order of the keys
    assert all(b == (a[0], a[1] + 1) or (b[0] > a[0] and b[1] == 0) for a, b in zip(placed, placed[1:])) and placed[0][1] == 0
    total, part, most = sum(h[3] for h in held), sum(h[3] for h in held) / shards, max(h[3] for h in held)
    for cut in range(1, shards):
        below = sum(h[3] for h, (shard, _) in zip(held, placed, strict=True) if shard < cut)
        assert abs(below - total * cut / shards) <= 0.011 * part + most
