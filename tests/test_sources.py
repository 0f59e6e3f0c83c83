from __future__ import annotations

import gzip
import io
import zipfile
from datetime import date, datetime
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.functions import normal, text
from tidemark.sources import parsers, prices, sinks
from tidemark.sources.tables import load


def test_master_index(spark, tmp_path):
    (tmp_path / "a.idx").write_text("Description: x\n\nCIK|Company Name|Form Type|Date Filed|Filename\n-----\n1|A CO|10-K|2021-02-11|edgar/data/1/0001-21-1.txt\n2|PIPE | NAME|10-K/A|2021-03-31|edgar/data/2/0002-21-1.txt\nbad|line\n")
    out = rows(parsers.build_index(spark.read.text(str(tmp_path)), ["10-K", "10-K/A"]).select("cik", "company", "form_type", "date_filed", "accession"))
    assert out == [(1, "A CO", "10-K", date(2021, 2, 11), "0001-21-1"), (2, "PIPE | NAME", "10-K/A", date(2021, 3, 31), "0002-21-1")]


def test_quarters_and_urls(spark):
    q = spark.range(1).select(
        parsers.quarter_is_complete(F.lit(2021), F.lit(1), F.lit(date(2021, 4, 1))).alias("a"), parsers.quarter_is_complete(F.lit(2021), F.lit(1), F.lit(date(2021, 3, 31))).alias("b"),
        parsers.folder_url(F.lit("h"), F.lit(7), F.lit("00-1-2")).alias("c"), parsers.index_url(F.lit("h"), F.lit(2020), F.lit(3)).alias("d"),
        parsers.eastern(F.lit(" 2021-03-02 04:30:00 ")).alias("e"), parsers.eastern(F.lit("x")).alias("f"),
    ).first()
    assert tuple(q) == (True, False, "h/edgar/data/7/0012", "h/edgar/full-index/2020/QTR3/master.idx", datetime(2021, 3, 2, 9, 30), None)


PAGE = """<div class="infoHead">Accepted</div><div class="info">2025-02-11 17:29:21</div><div class="infoHead">Period of Report</div><div class="info">2024-12-31</div>
<table class="tableFile" summary="Document Format Files"><tr><th>Seq</th></tr><tr><td>1</td><td>x</td><td><a href="/ix?doc=/Archives/a.htm">a.htm</a></td><td>10-K</td></tr>
<tr><td>2</td><td>x</td><td><a href="/b.htm">b</a></td><td>EX-1</td></tr></table>"""


def test_index_pages(spark):
    df = spark.createDataFrame([("a", "10-K", PAGE), ("b", "10-K", "<p>nothing</p>"), ("c", "8-K", PAGE), ("d", "10-K", None)], "accession string, form_type string, html string")
    out = {r["accession"]: r for r in parsers.index_pages(df, "https://h").collect()}
    assert out["a"]["acceptance_datetime"] == datetime(2025, 2, 11, 22, 29, 21) and out["a"]["period_of_report"] == date(2024, 12, 31) and out["a"]["primary_doc_url"] == "https://h/Archives/a.htm"
    assert out["b"]["fetch_error"] == out["d"]["fetch_error"] == "no acceptance time" and out["c"]["primary_doc_url"] is None


def test_public_float_membership_and_tickers(spark):
    raw = '{"units": {"USD": [{"end": "2020-06-30", "val": 2e9, "filed": "2021-02-01", "form": "10-K"}, {"end": "2020-06-30", "val": 3e9, "filed": "2021-03-01", "form": "10-K/A"}, {"end": "2019-06-30", "val": 5, "filed": "2020-02-01", "form": "10-K"}]}}'
    out = parsers.public_float(spark.createDataFrame([(1, raw), (2, "{}"), (3, "broken")], "cik int, json string"))
    assert rows(out) == [(1, date(2020, 6, 30), 2e9, date(2021, 2, 1))]
    m = parsers.membership(spark.createDataFrame([("2020-01-01", "AAA, BBB ,CCC")], "date string, tickers string"))
    assert [r["ticker"] for r in m.collect()] == ["AAA", "BBB", "CCC"]


def test_factor_zip():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("f.csv", "created using the 202412 CRSP database\n\n,Mkt-RF,SMB\n202001, 1.50,-99.99\n202002,-2.00, 0.50\n\nAnnual\n2020, 9, 9\n")
    df, vintage = parsers.factor_zip(buf.getvalue())
    assert vintage == "202412" and df["month_end"].tolist() == [date(2020, 1, 31), date(2020, 2, 29)]
    assert df["Mkt-RF"].tolist() == [0.015, -0.02] and df["SMB"].isna().tolist() == [True, False]


def test_constituents():
    html = (
        "<table><tr><th>Symbol</th><th>Security</th><th>CIK</th></tr><tr><td>aaa</td><td>A</td><td>0000001</td></tr></table>"
        "<table><tr><th>Date</th><th>Ticker</th><th>Security</th><th>Ticker</th><th>Security</th><th>Reason</th></tr><tr><td>d</td><td>bbb</td><td>B</td><td></td><td></td><td>r</td></tr></table>"
    )
    now, names = parsers.constituents(html)
    assert now.to_dict("records") == [{"ticker": "AAA", "name": "A", "cik": 1}] and names.to_dict("records") == [{"ticker": "BBB", "name": "B"}]


def test_dictionary_keeps_na(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("Word,Negative,Uncertainty\nna,2009,0\nNAN,0,-2014\nloss,2009,2011\n")
    master = parsers.dictionary(spark, str(p))
    assert {r["Word"] for r in master.collect()} == {"NA", "NAN", "LOSS"}
    assert rows(parsers.lexicon(master, ["negative", "uncertainty"])) == [("LOSS", "negative", "a", 2009), ("LOSS", "uncertainty", "a", 2011), ("NA", "negative", "a", 2009), ("NAN", "uncertainty", "r", 2014)]


def test_names_and_labels(spark):
    df = spark.createDataFrame([("\tabc1-a ", " Health Care", "Anadarko & Sons Petroleum Corp /DE/"), ("  ", None, None)], "t string, s string, c string")
    out = df.select(normal.ticker(F.col("t")), normal.label(F.col("s")), text.company_name(F.col("c"))).collect()
    assert tuple(out[0]) == ("ABC1.A", "health care", "anadarko and sons petroleum") and tuple(out[1]) == (None, None, None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("h1", 1, 0.5), ("h2", 1, 0.25)], "config_hash string, run_at int, sharpe double")
    log = str(tmp_path / "log")
    sinks.append_log(df, log)
    sinks.append_log(df.withColumn("run_at", F.lit(2)).limit(1), log)
    back = spark.read.csv(log, header=True, inferSchema=True)
    assert back.count() == 3 and {(r["config_hash"], r["run_at"]) for r in sinks.latest_runs(back).collect()} == {("h1", 2), ("h2", 1)}
    up = sinks.upsert(df, spark.createDataFrame([("h1", 9, 9.0)], df.schema), ["config_hash"])
    assert rows(up) == [("h1", 9, 9.0), ("h2", 1, 0.25)]
    assert [r["config_hash"] for r in sinks.not_done(df, df.limit(1), ["config_hash"]).collect()] == ["h2"]
    assert sinks.json_rows(df.limit(1)).first()["json"] == '{"config_hash":"h1","run_at":1,"sharpe":0.5}'
    assert "| h1 | 1 | 0.5000 |" in sinks.markdown_table(df)
    sinks.write_table(df, str(tmp_path / "t"), ["config_hash"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_documents_and_digests(spark, tmp_path):
    (tmp_path / "a.htm").write_bytes(b"plain")
    (tmp_path / "b.htm.gz").write_bytes(gzip.compress(b"packed"))
    out = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in sinks.read_documents(spark, str(tmp_path)).collect()}
    assert out == {"a.htm": b"plain", "b.htm.gz": b"packed"}
    with pytest.raises(ValueError, match="pinned"):
        sinks.checked_bytes(str(tmp_path / "a.htm"), "0" * 64)


def test_price_source(spark, tmp_path):
    prices.register(spark)
    df = spark.createDataFrame([(date(2020, 1, 1), "A", 1.5), (date(2020, 1, 2), "B", 2.5)], prices.SCHEMA)
    df.write.parquet(str(tmp_path / "p"))
    assert rows(spark.read.format("tidemark_prices").option("path", str(tmp_path / "p")).load()) == rows(df)


def test_zoneless_times_are_utc(spark, tmp_path):
    spark.sql("SELECT TIMESTAMP_NTZ'2020-01-01 00:00:00' AS t").write.parquet(str(tmp_path / "x.parquet"))
    assert load(spark, str(tmp_path), "x").dtypes == [("t", "timestamp")]


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(round(s, 6))
        self.now += s


def test_rate_limit_books_slots():
    from tidemark.sources.fetch import RateLimiter

    c = Clock()
    lim = RateLimiter(4, c, c.sleep)
    for _ in range(3):
        lim.wait()
    c.now += 10
    lim.wait()
    assert c.slept == [0.25, 0.25]


def client(tmp_path, replies, clock):
    from tidemark.sources.fetch import CachedClient, RateLimiter

    calls = []

    def opener(url):
        calls.append(url)
        return replies[min(len(calls), len(replies)) - 1]

    return CachedClient(opener, str(tmp_path), RateLimiter(1000, clock, clock.sleep), sleep=clock.sleep), calls


def test_client_retries_caches_and_gives_up(tmp_path):
    from tidemark.sources.fetch import FetchError

    c = Clock()
    ok, calls = client(tmp_path / "a", [(503, b""), (429, b""), (200, b"body")], c)
    assert ok.get("u", "k") == b"body" and ok.get("u", "k") == b"body" and len(calls) == 3 and {1.0, 2.0} <= set(c.slept)
    bad, calls = client(tmp_path / "b", [(404, b"")], c)
    with pytest.raises(FetchError, match="404"):
        bad.get("u", "k")
    assert len(calls) == 1 and [x.name for x in (tmp_path / "b").glob("*")] == ["k.missing"]
    with pytest.raises(FetchError, match="404"):
        bad.get("u", "k")
    assert len(calls) == 1 and bad.known_missing("k")
    fresh, calls = client(tmp_path / "a", [(200, b"new")], c)
    assert fresh.get("u", "k") == b"body" and fresh.get("u", "k", refresh=True) == b"new" == fresh.get("u", "k") and len(calls) == 1


def test_fetch_all_keeps_errors(spark, tmp_path):
    from tidemark.sources import fetch

    folder = str(tmp_path / "c")

    def make():
        return fetch.CachedClient(lambda url: (200, b"x") if url.startswith("good") else (404, b""), folder, fetch.RateLimiter(1000))

    df = spark.createDataFrame([("good1", "a", 1), ("bad", "b", 2), ("good1", "a", 3), (None, None, 4)], "url string, key string, cik int")
    out = {r["cik"]: (r["doc_path"] is not None, r["fetch_error"]) for r in fetch.fetch_all(df, make, url="url", key="key").collect()}
    assert out == {1: (True, None), 3: (True, None), 2: (False, "NotFound: bad: status 404"), 4: (False, None)}


def test_floats_and_prices_are_asked_for_once(spark, tmp_path):
    from tidemark.sources import fetch

    log, cache, prices_at = str(tmp_path / "log"), str(tmp_path / "c"), str(tmp_path / "p")

    def make():
        def opener(url):
            with open(log, "a") as f:
                f.write(url + "\n")
            return (404, b"") if url.endswith("/7") else (500, b"") if url.endswith("/8") else (200, b'{"units": {}}')

        return fetch.CachedClient(opener, cache, fetch.RateLimiter(1000), tries=1)

    ciks = spark.createDataFrame([(7,), (8,), (9,), (9,), (None,)], "cik int").coalesce(1)
    for _ in range(2):
        out = {r["cik"]: (r["json"], r["fetch_error"]) for r in fetch.fetch_floats(ciks, make, address="u/%d").collect()}
        assert out == {7: (None, None), 8: (None, "FetchError: u/8: status 500"), 9: ('{"units": {}}', None)}
    assert sorted(open(log).read().split()) == ["u/7", "u/8", "u/8", "u/9"]

    def source():
        def ask(symbols):
            with open(log, "a") as f:
                f.write(",".join(sorted(symbols)) + "\n")
            rows = [(date(2020, 1, 1), s, 2.0) for s in symbols if s == "A"]
            return pd.DataFrame(rows, columns=["date", "symbol", "adj_close"])

        return ask

    open(log, "w").close()
    for symbols in (["A", "B"], ["A", "B", "C"], ["C"]):
        df = spark.createDataFrame([(x,) for x in symbols], "symbol string").coalesce(1)
        got = fetch.fetch_prices(df, source, prices_at, pause=0).collect()
        assert [tuple(r) for r in got] == ([(date(2020, 1, 1), "A", 2.0)] if "A" in symbols else [])
    assert open(log).read().split() == ["A,B", "C", "C"]  # a batch that is empty as a whole is no answer


def test_config(tmp_path):
    from tidemark.config import load_config

    (tmp_path / "c.json").write_text('{"portfolio": {"cost_bp": 5}}')
    c = load_config(str(tmp_path / "c.json"), {"TIDEMARK_PORTFOLIO__QUANTILES": "10", "OTHER": "x"})
    assert c["portfolio"]["cost_bp"] == 5 and c["portfolio"]["quantiles"] == 10 and c["pairs"]["min_gap_days"] == 270
    with pytest.raises(KeyError):
        load_config(env={"TIDEMARK_PORTFOLIO__NOPE": "1"})


def test_stages_name_known_queries():
    from tidemark.__main__ import STAGES
    from tidemark.plans import core

    assert {q for qs in STAGES.values() for q in qs} <= set(core().queries)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_every_price_series_comes_out_of_the_wide_form(spark):
    from tidemark import __main__ as runner
    from tidemark.plans import core, roles

    d = "/root/testdata/sf0.001"
    (name,) = [n for n in runner.STAGES["prices"] if n.startswith("wide_to_long")]
    want = {r[0] for r in roles.monthly(spark, d).select(F.col("symbol").cast("string")).distinct().collect()}
    assert {r["symbol"] for r in core().queries[name](spark, d).select("symbol").distinct().collect()} == want and len(want) > 4
