from __future__ import annotations

import random

import numpy as np
import pytest

from tidemark.llm import entity_match as em


def test_names():
    assert em.parse_name("Glass, Kezostol (Group Inc)") == ("kezostol", "glass", "group inc", None)
    assert em.parse_name("Bank, Lomask Ltd") == ("lomask", "bank", "ltd", None) and em.parse_name("Lomask Bank, L.P.") == ("lomask", "bank", "lp", None)
    assert em.parse_name("THE Wafédérk Brew. Holdings, Incorporated /WA/") == ("wafederk", "brew", "holdings inc", "wa")
    assert em.parse_name("Zu-nidem Water L.P.") == ("zunidem", "water", "lp", None) and em.parse_name("Mo wotand & Payments Trust")[:2] == ("mowotand", "payments")
    assert em.parse_name(None) == em.parse_name("") == (None, None, None, None) and em.parse_name("Inc")[0] is None


def test_distance():
    assert em.edits("abcd", "abdc") == 1 and em.edits("abc", "abc") == 0 and em.edits("", "ab") == 2 and em.edits("kitten", "sitting") == 3
    assert em._shortened("retl", "retail") and em._shortened("aero", "aerospace") and not em._shortened("water", "retail")


def test_symbols(spark):
    vals = ["XNX:abc1", "ABC1 US", "ABC1/A US", " abc1-a", "", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    assert [r[0] for r in df.select(em.symbol_form(df["s"])).collect()] == ["ABC1", "ABC1", "ABC1.A", "ABC1.A", None, None]


def companies(seed, n):
    r = random.Random(seed)
    syl = ["ba", "ke", "zor", "tri", "mun", "vek", "pol", "dra", "sim", "hug", "wen", "cor"]
    out = []
    for i in range(n):
        core = "".join(r.choice(syl) for _ in range(3))
        y0 = r.randrange(2005, 2018)
        out.append({"core": core, "trade": r.choice(["glass", "water", "retail", "mining"]), "form": r.choice(["inc", "ltd", "co"]), "state": r.choice(["de", "ny", None]), "symbol": f"{core[:3].upper()}{i % 10}", "tail": f"{r.randrange(10_000):04d}", "y0": y0, "y1": y0 + r.randrange(2, 12)})
    return out


def noisy(c, r):
    c = dict(c)
    if r.random() < 0.3:
        p = r.randrange(1, len(c["core"]) - 1)
        c["core"] = c["core"][:p] + c["core"][p + 1 :]
    for k, p in (("symbol", 0.3), ("tail", 0.3), ("state", 0.4), ("trade", 0.1)):
        if r.random() < p:
            c[k] = None
    c["y0"] += r.choice([-1, 0, 0, 1])
    return c


SCHEMA = "id int, core string, trade string, form string, state string, symbol string, tail string, y0 int, y1 int"


def frame(spark, cs):
    return spark.createDataFrame([(i, *[c[k] for k in em._SIDE]) for i, c in enumerate(cs)], SCHEMA)


def test_pairs_are_found_with_calibrated_confidence(spark):
    r = random.Random(1)
    base = companies(1, 400)
    out = em.match_entities(frame(spark, [noisy(c, r) for c in base]), frame(spark, [noisy(c, r) for c in base[:300]] + companies(2, 100))).toPandas()
    hit = out[out["confidence"] >= em.MATCH_AT]
    true = hit["left_id"] == hit["right_id"]
    assert true.mean() > 0.97 and true.sum() > 0.93 * 300
    assert out["confidence"].between(0, 1).all()
    sure = out[out["confidence"] > 0.95]
    assert (sure["left_id"] == sure["right_id"]).mean() > 0.97


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], SCHEMA)
    nulls = spark.createDataFrame([(1, *[None] * 8), (None, *[None] * 8)], SCHEMA)
    for a, b in ((empty, empty), (nulls, nulls), (nulls, empty)):
        assert em.match_entities(a, b).collect() == []


def test_a_frequent_attribute_alone_makes_no_candidates(spark):
    """A third of both sides share name or symbol; only agreement in two attributes blocks."""
    left, right = companies(3, 300), companies(4, 300)
    r = random.Random(0)
    for c in left + right:
        c["core"] = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    for i in range(100):
        left[i]["symbol"] = right[i]["symbol"] = "HOT1"
        left[i]["y0"], right[i]["y0"] = 2005 + i % 3, 2015 + i % 3
    assert em.candidates(frame(spark, left), frame(spark, right)).count() < 1500


def test_logistic_regression_recovers_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5000, 2))
    y = (rng.random(5000) < em._sigmoid(x @ np.array([2.0, -1.0]) + 0.5)).astype(float)
    assert em.fit_logistic(x, y, np.ones(5000), penalty=1e-3) == pytest.approx([2.0, -1.0, 0.5], abs=0.2)


def test_a_hot_symbol_and_year_without_last_years_is_compared_whole(spark):
    """60 x 60 rows that share symbol and first year and know no last year all meet."""
    a, b = ([dict(c, symbol="HOT1", y0=2010, y1=None, form=None, state=None) for c in companies(seed, 60)] for seed in (5, 6))
    assert em.candidates(frame(spark, a), frame(spark, b)).count() == 3600


def test_candidate_recall_before_scoring(spark):
    """True pairs that blocks miss: overall, and where a third of the rows share symbol and year."""
    r = random.Random(12)
    base = companies(12, 600)
    dirty = [noisy(c, r) for c in base]
    met = {tuple(x) for x in em.candidates(frame(spark, base), frame(spark, dirty)).collect()}
    assert sum((i, i) in met for i in range(600)) >= 0.97 * 600
    for c in base[:200]:
        c.update(symbol="HOT1", y0=2010, y1=None)
    dirty = [noisy(c, r) for c in base]
    met = {tuple(x) for x in em.candidates(frame(spark, base), frame(spark, dirty)).collect()}
    assert sum((i, i) in met for i in range(600)) >= 0.97 * 600


def test_confidences_do_not_depend_on_partitions(spark):
    r = random.Random(3)
    base = companies(13, 200)
    a, b = frame(spark, [noisy(c, r) for c in base]), frame(spark, [noisy(c, r) for c in base])
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n, df in ((8, b), (3, b.orderBy("core"))):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append({(x["left_id"], x["right_id"]): x["confidence"] for x in em.match_entities(a, df.repartition(n)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and len(got[0]) > 150


def test_a_company_with_most_rows_keeps_all_its_pairs(spark):
    """Every block of one company is crowded; its rows lack form, trade and state, and last years differ or miss."""
    left, right = companies(7, 150), companies(8, 150)
    right[:100] = [dict(c) for c in left[:100]]
    hot = {"core": "qualopter", "trade": None, "form": None, "state": None, "symbol": "QUA1", "tail": "0815", "y0": 2010}
    a = [dict(hot, y1=(None, 2014, 2016)[i % 3]) for i in range(1050)] + left
    b = [dict(hot, y1=(None, 2018)[i % 2]) for i in range(1050)] + right
    out = em.match_entities(frame(spark, a), frame(spark, b)).where(f"confidence >= {em.MATCH_AT}")
    assert out.where("left_id < 1050 AND right_id < 1050").distinct().count() == 1050 * 1050
    assert out.where("left_id >= 1050 AND left_id = right_id").count() >= 95 and out.where("left_id < 1050 AND right_id >= 1050 OR left_id >= 1050 AND right_id < 1050").isEmpty()


def test_collapsing_and_salting_lose_no_candidates(spark):
    r = random.Random(9)
    base = companies(9, 60)
    a, b = (frame(spark, [noisy(r.choice(base), r) for _ in range(200)]) for _ in range(2))
    met = lambda p, q: em._block_keys(p, em.YEARS_APART).alias("p").join(em._block_keys(q, 0).alias("q"), "block").where("p.y0 IS NULL OR abs(p.y0 - q.y0) <= 2")
    plain = {tuple(x) for x in met(a, b).select("p.id", "q.id").collect()}
    for salted in (1_000_000, 5):
        got = [tuple(x) for x in em.candidates(a, b, salted=salted).collect()]
        assert len(got) == len(set(got)) and set(got) == plain
