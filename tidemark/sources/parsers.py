"""Parsers of the published formats, as DataFrame transformations of raw text or documents."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.normal import NEW_YORK, ticker

FLOAT_RANGE = (1e6, 5e12)


def master_index(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines of a pipe-delimited filing index -> (cik, company, form_type, date_filed, accession, filename).

    A row is a number, a name that may hold pipes itself, and three fields without any; the header,
    dashes and anything else match nothing and drop out, so files can be split anywhere.
    """
    row = r"^(\d+)\|(.*)\|([^|]*)\|([^|]*)\|([^|]*)$"
    part = lambda i: F.regexp_extract(line, row, i)
    return lines.where(F.col(line).rlike(row)).select(
        part(1).cast("bigint").alias("cik"), F.trim(part(2)).alias("company"), F.trim(part(3)).alias("form_type"),
        F.try_to_date(part(4), "yyyy-MM-dd").alias("date_filed"), accession(part(5)).alias("accession"), part(5).alias("filename"),
    )


def accession(filename: Column) -> Column:
    return F.regexp_extract(filename, r"([^/]+?)(?:\.txt)?$", 1)


def build_index(lines: DataFrame, forms: list[str]) -> DataFrame:
    """The index over many files: chosen forms, one row per (accession, cik), of several the first by
    day, name, form and file."""
    rest = ["date_filed", "company", "form_type", "filename"]
    first = master_index(lines).where(F.col("form_type").isin(forms)).groupBy("accession", "cik").agg(F.min(F.struct(*rest)).alias("_r"))
    return first.select("cik", "_r.company", "_r.form_type", "_r.date_filed", "accession", "_r.filename")


def quarter_is_complete(year: Column, quarter: Column, today: Column) -> Column:
    return today >= F.add_months(F.make_date(year, quarter * 3, F.lit(1)), 1)


def index_quarters(years: DataFrame, *, base: Column, today: Column) -> DataFrame:
    """(year, quarter, url, use_cache) of the quarterly indexes of ``years`` that have begun by
    ``today``; the one in progress still grows, so its copy in a cache is not to be trusted."""
    q = years.withColumn("quarter", F.explode(F.sequence(F.lit(1), F.lit(4)))).where(F.make_date("year", F.col("quarter") * 3 - 2, F.lit(1)) <= today)
    return q.select("year", "quarter", index_url(base, F.col("year"), F.col("quarter")).alias("url"), quarter_is_complete(F.col("year"), F.col("quarter"), today).alias("use_cache"))


def eastern(text: Column) -> Column:
    """A New York wall time as an instant; null where it is none."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.trim(text), F.lit("yyyy-MM-dd HH:mm:ss")), NEW_YORK)


def index_url(base: Column, year: Column, quarter: Column) -> Column:
    return F.format_string("%s/edgar/full-index/%d/QTR%d/master.idx", base, year, quarter)


def folder_url(base: Column, cik: Column, accession_: Column) -> Column:
    return F.format_string("%s/edgar/data/%d/%s", base, cik, F.translate(accession_, "-", ""))


def public_float(raw: DataFrame, json: str = "json", keys: tuple[str, ...] = ("cik",)) -> DataFrame:
    """XBRL facts -> (keys..., end, value, filed): annual reports only, plausible values, the first
    filing of each measurement."""
    schema = "units struct<USD: array<struct<end: string, val: double, filed: string, form: string>>>"
    facts = raw.select(*keys, F.inline(F.from_json(json, schema).getField("units").getField("USD")))
    good = facts.where(F.col("form").startswith("10-K") & F.col("val").between(*FLOAT_RANGE))
    return good.groupBy(*keys, F.to_date("end").alias("end")).agg(F.min_by("val", "filed").alias("value"), F.to_date(F.min("filed")).alias("filed"))


def membership(rows: DataFrame) -> DataFrame:
    """(date, tickers as a comma list) -> (snapshot_date, ticker)."""
    return rows.select(F.to_date("date").alias("snapshot_date"), F.explode(F.split("tickers", ",")).alias("t")).select("snapshot_date", F.trim("t").alias("ticker"))


def listed_tickers(raw: DataFrame, json: str = "json") -> DataFrame:
    """A JSON object of numbered rows -> (ticker, cik, title, rank); rank 0 is a company's first class.

    One small published file, so the window over a company's classes is short.
    """
    parsed = F.from_json(json, "map<string, struct<cik_str: bigint, ticker: string, title: string>>")
    rows = raw.select(F.explode(parsed).alias("k", "r")).select(F.col("k").cast("int").alias("at"), "r.*")
    rank = F.row_number().over(W.partitionBy("cik_str").orderBy("at")) - 1
    return rows.select(ticker(F.col("ticker")).alias("ticker"), F.col("cik_str").alias("cik"), "title", rank.alias("rank"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A word list with header; the words NA and NAN stay words."""
    df = spark.read.csv(path, header=True, nullValue="\0")
    return df.withColumn("Word", F.upper("Word"))


def lexicon(master: DataFrame, categories: list[str]) -> DataFrame:
    """Wide code columns -> (word, category, kind, year): code > 0 added in that year, < 0 removed."""
    long = master.unpivot("Word", [c.capitalize() for c in categories], "category", "code").withColumn("code", F.col("code").cast("int")).where("code <> 0")
    return long.select(F.upper("Word").alias("word"), F.lower("category").alias("category"), F.when(F.col("code") > 0, "a").otherwise("r").alias("kind"), F.abs("code").alias("year"))


def wide_prices(wide: DataFrame, date: str = "date") -> DataFrame:
    """One column per symbol -> (date, symbol, adj_close), empty cells dropped."""
    symbols = [c for c in wide.columns if c != date]
    return wide.unpivot(date, symbols, "symbol", "adj_close").where("adj_close IS NOT NULL AND NOT isnan(adj_close)")


def factor_zip(raw: bytes) -> tuple[pd.DataFrame, str | None]:
    """Monthly block of a zipped factor file -> (month_end and factor columns as decimals, vintage)."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        text = z.read(z.namelist()[0]).decode("latin-1")
    names: list[str] = []
    rows: list[list[str]] = []
    for line in text.splitlines():
        cells = [c.strip() for c in line.split(",")]
        if not names:
            if re.match(r",\s*[A-Za-z]", line):
                names = cells[1:]
        elif re.fullmatch(r"\d{6}", cells[0]):
            rows.append(cells)
        else:
            break
    df = pd.DataFrame(rows, columns=["month_end", *names])
    df["month_end"] = (pd.to_datetime(df["month_end"], format="%Y%m") + pd.offsets.MonthEnd(0)).dt.date
    values = df[names].astype(float)
    df[names] = values.mask(values.isin([-99.99, -999.0])) / 100
    found = re.search(r"created using the (\d{6}) CRSP database", text)
    return df, found.group(1) if found else None


class _IndexPage(HTMLParser):
    """Labels with their values, and the cells and link of every row of the document table."""

    def __init__(self) -> None:
        super().__init__()
        self.info: dict[str, str] = {}
        self.rows: list[tuple[list[str], str | None]] = []
        self._label, self._into, self._buffer = "", "", ""
        self._in_table, self._cells, self._href = False, [], None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "div" and a.get("class") in ("infoHead", "info"):
            self._into, self._buffer = a["class"], ""
        elif tag == "table":
            self._in_table = a.get("class") == "tableFile" and a.get("summary") == "Document Format Files"
        elif self._in_table and tag == "tr":
            self._cells, self._href = [], None
        elif self._in_table and tag == "td":
            self._into, self._buffer = "td", ""
        elif self._in_table and tag == "a" and self._href is None:
            self._href = a.get("href")

    def handle_data(self, data: str) -> None:
        if self._into:
            self._buffer += data

    def handle_endtag(self, tag: str) -> None:
        if tag == "div" and self._into in ("infoHead", "info"):
            if self._into == "infoHead":
                self._label = self._buffer.strip()
            elif self._label:
                self.info.setdefault(self._label, self._buffer.strip())
                self._label = ""
            self._into = ""
        elif tag == "td" and self._into == "td":
            self._cells.append(self._buffer.strip())
            self._into = ""
        elif tag == "tr" and self._in_table:
            self.rows.append((self._cells, self._href))
        elif tag == "table":
            self._in_table = False


def index_page(html: str, form_type: str, host: str) -> tuple[str | None, str | None, str | None]:
    """(accepted wall time, period, link of the first document of the form) of a filing's page."""
    page = _IndexPage()
    page.feed(html)
    link = next((href for cells, href in page.rows if href and len(cells) >= 4 and cells[3] == form_type), None)
    return page.info.get("Accepted"), page.info.get("Period of Report"), host + re.sub(r"^/ix\?doc=", "", link) if link else None


def index_pages(pages: DataFrame, host: str) -> DataFrame:
    """(accession, form_type, html) -> acceptance instant, period and document; a page without an
    acceptance time says so in ``fetch_error`` and stops nothing."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for acc, form, html in zip(pdf["accession"], pdf["form_type"], pdf["html"]):
                try:
                    accepted, period, url = index_page(html or "", form, host)
                    out.append((acc, accepted, period, url, None if accepted else "no acceptance time"))
                except Exception as e:  # noqa: BLE001
                    out.append((acc, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["accession", "accepted", "period", "primary_doc_url", "fetch_error"])

    rows = pages.select("accession", "form_type", "html").mapInPandas(read, "accession string, accepted string, period string, primary_doc_url string, fetch_error string")
    return rows.select("accession", eastern(F.col("accepted")).alias("acceptance_datetime"), F.try_to_date("period", "yyyy-MM-dd").alias("period_of_report"), "primary_doc_url", "fetch_error")


class _Tables(HTMLParser):
    """Cell texts of every table, row by row."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self._cell: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th"):
            self._cell = ""

    def handle_data(self, data: str) -> None:
        if self._cell is not None:
            self._cell += data

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self._cell is not None and self.tables and self.tables[-1]:
            self.tables[-1][-1].append(self._cell.strip())
            self._cell = None


def constituents(html: str) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(current members with their number, names from the change log) of a constituents page."""
    page = _Tables()
    page.feed(html)
    head, *body = page.tables[0]
    at = [head.index(c) for c in ("Symbol", "Security", "CIK")]
    now = pd.DataFrame([[r[i] for i in at] for r in body if len(r) >= len(head)], columns=["ticker", "name", "cik"])
    now["ticker"], now["cik"] = now["ticker"].str.upper(), now["cik"].astype("int64")
    moves = [r for r in page.tables[1] if len(r) >= 6] if len(page.tables) > 1 else []
    names = pd.DataFrame([p for r in moves for p in ((r[1], r[2]), (r[3], r[4])) if all(p)], columns=["ticker", "name"])
    names["ticker"] = names["ticker"].str.upper()
    return now, names[names["ticker"] != "TICKER"].drop_duplicates(ignore_index=True)
