from __future__ import annotations

import math
import random

import pytest

from tidemark.llm import mixing, packing, tokens


@pytest.mark.parametrize("seed", range(4))
def test_fill_never_overflows_and_wastes_little(seed):
    r = random.Random(seed)
    sizes = [min(99, int(r.lognormvariate(2.5, 1)) + 1) for _ in range(3000)]
    bins, _ = packing.fill(sizes, 100)
    load = {}
    for b, s in zip(bins, sizes):
        load[b] = load.get(b, 0) + s
    assert max(load.values()) <= 100 and len(bins) == 3000
    assert len(load) <= 1.02 * math.ceil(sum(sizes) / 100) + 1


def test_fill_keeps_class_counts():
    n_bins = lambda sizes, **kw: len(set(packing.fill(sizes, 100, **kw)[0]))
    assert n_bins([60] * 5) == 5 and n_bins([40] * 6) == 3 and n_bins([34] * 4) == 2 and packing.fill([], 10) == ([], [])
    assert n_bins([60, 40, 60, 40]) == 2 and n_bins([60, 40, 60, 40], refill=False) == 3  # left-over room is refilled
    r = random.Random(3)
    sizes = [r.randrange(1, 101) for _ in range(4000)]
    bins, moved = packing.fill(sizes, 100, refill=False)
    held = {}
    for b, s in zip(bins, sizes):
        held.setdefault(b, []).append(s)
    assert not any(moved)
    for j in range(1, packing.CLASSES):  # a class fills its bins with its count, all but the last one
        own = [len(x) for x in held.values() if min(100 // x[0], packing.CLASSES) == j]
        assert all(min(100 // s, packing.CLASSES) == j for x in held.values() if min(100 // x[0], packing.CLASSES) == j for s in x)
        assert sorted(own)[1:] == [j] * (len(own) - 1)


def test_the_packing_does_not_depend_on_splits(spark):
    r = random.Random(8)
    items = [(r.randrange(300), r.randrange(1, 90)) for _ in range(900)] + [(5, 40)] * 9000
    boxes = spark.createDataFrame([("a", 64)], "container string, capacity_tokens int")
    got = []
    for parts in (2, 7):
        r.shuffle(items)
        df = spark.createDataFrame(items, "doc_id bigint, tokens bigint").repartition(parts)
        got.append(sorted(map(tuple, packing.pack(df, boxes, items_per_worker=700).collect())))
    assert got[0] == got[1]
    assert sum(x[7] for x in got[0]) == sum(t for _, t in items)


def test_pack(spark):
    r = random.Random(5)
    items = [(i, r.choice([0, None, 1, 7, 30, 64, 65, 200, 640])) for i in range(500)] + [(7, 30)] * 200 + [(None, 5)]
    df = spark.createDataFrame(items, "doc_id bigint, tokens bigint").repartition(3)
    boxes = spark.createDataFrame([("a", 64), ("b", 100), ("a", 64), ("bad", 0), ("none", None)], "container string, capacity_tokens int")
    out = packing.pack(df, boxes, items_per_worker=100).toPandas()
    for name, cap in (("a", 64), ("b", 100)):
        x = out[out["container"] == name]
        assert x.groupby("bin_id")["tokens"].sum().max() <= cap
        assert x["tokens"].sum() == sum(t or 0 for _, t in items)
        whole = x.groupby(["doc_id"], dropna=False)["tokens"].sum().to_dict()
        assert whole[7] == 30 * 200 + (items[7][1] or 0)
        for d, parts in x[x["part"] > 0].groupby("doc_id"):
            assert (items[int(d)][1] or 0) > cap
        cut = x[x["doc_id"].isin([i for i, t in items[:500] if t == 640])].sort_values(["doc_id", "part"])
        assert (cut["first_token"] == cut["part"] * cap).all()
    assert set(out["container"]) == {"a", "b"}
    share = {r["container"]: r["unused_share"] for r in packing.unused_share(packing.pack(df, boxes, items_per_worker=100_000)).collect()}
    assert 0 <= share["a"] < 0.1 and 0 <= share["b"] < 0.1
    assert packing.pack(df.limit(0), boxes).collect() == [] and packing.pack(df, boxes.limit(0)).collect() == []


def test_poisson_quantiles():
    for rate in (0.1, 1.0, 3.7):
        steps = mixing.poisson_steps(rate, 4)
        assert steps == sorted(steps) and steps[0] == pytest.approx(math.exp(-rate))
        assert mixing.mean_repeats(mixing.rate_for(mixing.mean_repeats(rate, 4), 4), 4) == pytest.approx(mixing.mean_repeats(rate, 4))
    assert mixing.rate_for(4, 4) == math.inf and mixing.rate_for(0, 4) == 0 and mixing.poisson_steps(math.inf, 3) == [-1.0] * 3


def test_large_rates():
    rate = mixing.rate_for(650.0, 1000)
    assert math.isfinite(rate) and mixing.mean_repeats(rate, 1000) == pytest.approx(650.0)
    assert mixing.mean_repeats(mixing.rate_for(4999.5, 5000), 5000) == pytest.approx(4999.5, rel=1e-6) and mixing.poisson_steps(0, 2) == [1.0, 1.0]


def test_mix(spark):
    r = random.Random(2)
    docs = [(i, "big" if i < 3000 else "small" if i < 3300 else "tiny", r.randrange(1, 400)) for i in range(3310)] + [(None, "big", 5), (9999, None, 5), (9998, "big", 0), (9997, "big", None)]
    targets = [("m", "big", 0.5, 3), ("m", "small", 0.3, 8), ("m", "tiny", 0.2, 2), ("m2", "big", 1.0, 1), ("m2", "absent", 0.5, 4), ("m2", "small", None, 4)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    t = spark.createDataFrame(targets, "mix string, source string, target_share double, max_repeats int")
    selection, shares = mixing.mix_sources(d, t, total_tokens=400_000)
    got = {(x["mix"], x["source"]): x for x in shares.collect()}
    assert got["m", "big"]["tokens"] == pytest.approx(200_000, rel=0.01) and got["m", "small"]["tokens"] == pytest.approx(120_000, rel=0.02)
    assert got["m", "tiny"]["is_short"] and got["m", "tiny"]["n_used"] == 10 and not got["m", "big"]["is_short"]
    assert got["m2", "absent"]["tokens"] == 0 and got["m2", "absent"]["is_short"] and got["m2", "small"]["tokens"] == 0
    assert got["m", "tiny"]["exact_up_to"] == pytest.approx(2 * sum(t or 0 for _, src, t in docs if src == "tiny") / 0.2) and got["m2", "small"]["exact_up_to"] is None
    s = selection.toPandas()
    assert s.groupby(["mix", "source", "doc_id"]).size().groupby(["mix", "source"]).max().to_dict() == {("m", "big"): 3, ("m", "small"): s[s["source"] == "small"].groupby("doc_id").size().max(), ("m", "tiny"): 2, ("m2", "big"): 1}
    assert not s.duplicated(["mix", "doc_id", "repeat_no"]).any() and s["repeat_no"].le(8).all()
    for (m, src), g in s.groupby(["mix", "source"]):
        assert g["tokens"].sum() == got[m, src]["tokens"]
    m = s[s["mix"] == "m"].reset_index(drop=True)
    assert m["shuffle_key"].is_monotonic_increasing
    half = m["source"][: len(m) // 2].value_counts(normalize=True)["big"]
    assert half == pytest.approx((m["source"] == "big").mean(), abs=0.05)
    assert sum(x["actual_share"] for x in got.values() if x["mix"] == "m") == pytest.approx(1)


def test_mix_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id bigint, source string, tokens bigint")
    t = spark.createDataFrame([("m", "big", 0.5, 3)], "mix string, source string, target_share double, max_repeats int")
    selection, shares = mixing.mix_sources(d, t)
    assert selection.collect() == [] and shares.first()["tokens"] == 0 and shares.first()["actual_share"] == 0.0


def test_token_counts_of_long_texts():
    path = tokens.default_vocabulary()
    encode = tokens._encoding(path).encode_ordinary
    long = "Revenue rose in the third quarter, 1,234 units. " * 12_000
    assert "".join(tokens.pieces(long)) == long and len(list(tokens.pieces(long))) > 1
    assert tokens.count_tokens(long, path) == len(encode(long))
    assert tokens.count_tokens("x" * 300_000, path) > 0 and tokens.count_tokens("", path) == tokens.count_tokens(None, path) == 0
    assert tokens.count_tokens("two words", path) == 2
