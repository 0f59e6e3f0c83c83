"""As-of, membership, validity and entity-resolution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.catalog import Catalog
from tidemark.functions import normal, text
from tidemark.operators import asof, pit
from tidemark.plans import roles
from tidemark.sources.tables import load

catalog = Catalog()
DAY_US = 86_400_000_000
YEAR_US = 366 * DAY_US
MIN_GAP, MAX_GAP, WINDOW_DAYS = 270, 550, 400
LAST_DAY = "2025-12-31"
ASKED = ["2012-06-30", "2014-12-31", "2017-07-04", "2019-02-28", "2021-11-17", "2030-01-01"]
_ASKED_SQL = ", ".join(f"(DATE '{d}')" for d in ASKED)


def previous_filings(spark: SparkSession, d: str) -> DataFrame:
    """Each filing with the latest earlier one of its company that is 270 to 550 days older."""
    f = roles.filings(spark, d).where("t IS NOT NULL").select("accession", "cik", "t")
    prev = f.select("cik", F.col("t").alias("prev_t"), F.col("accession").alias("prev_accession"))
    hit = asof.asof_join(f, prev, keys=["cik"], left_time="t", right_time="prev_t", values=["prev_accession", "prev_t"], shift=-MIN_GAP * DAY_US, slice_width=YEAR_US)
    near = F.col("t") - F.col("prev_t") <= F.expr(f"INTERVAL {MAX_GAP} DAYS")
    return hit.select("accession", "cik", "t", *[F.when(near, F.col(c)).alias(c) for c in ("prev_accession", "prev_t")])


PREV_SQL = f"""prev_k AS (SELECT cik, t AS prev_t, max(accession) AS prev_accession FROM filings_r WHERE t IS NOT NULL GROUP BY cik, t),
cut_r AS (SELECT accession, cik, t, t - INTERVAL {MIN_GAP * 24} HOUR AS cutoff FROM filings_r WHERE t IS NOT NULL),
prev_j AS (SELECT c.*, p.prev_t, p.prev_accession FROM cut_r c ASOF LEFT JOIN prev_k p ON c.cik = p.cik AND c.cutoff >= p.prev_t),
prev_r AS (SELECT accession, cik, t, CASE WHEN epoch_us(t) - epoch_us(prev_t) <= {MAX_GAP * DAY_US} THEN prev_accession END AS prev_accession,
                  CASE WHEN epoch_us(t) - epoch_us(prev_t) <= {MAX_GAP * DAY_US} THEN prev_t END AS prev_t FROM prev_j)"""


@catalog.query("prev_filing_asof", f"WITH {roles.ctes('filings')}, {PREV_SQL} SELECT accession, cik, epoch_us(t) AS t_us, prev_accession, epoch_us(prev_t) AS prev_us FROM prev_r")
def prev_filing_asof(spark: SparkSession, d: str) -> DataFrame:
    return previous_filings(spark, d).select("accession", "cik", F.unix_micros("t").alias("t_us"), "prev_accession", F.unix_micros("prev_t").alias("prev_us"))


@catalog.query(
    "asof_strict_size",
    f"""WITH {roles.ctes('monthly')},
q AS (SELECT symbol, date_trunc('quarter', date)::DATE AS qs, avg(adj_close) AS value FROM monthly_r GROUP BY ALL),
flt AS (SELECT symbol, last_day((qs + INTERVAL 2 MONTH)::DATE) AS end_day, last_day((qs + INTERVAL 2 MONTH)::DATE) + 45 AS filed, value FROM q),
a AS (SELECT m.symbol, m.date, m.adj_close, f.end_day, f.value FROM monthly_r m ASOF LEFT JOIN flt f ON m.symbol = f.symbol AND m.date > f.filed),
b AS (SELECT a.*, p.adj_close AS then_close FROM a ASOF LEFT JOIN monthly_r p ON a.symbol = p.symbol AND a.end_day >= p.date)
SELECT symbol, date::VARCHAR AS date, CASE WHEN date_diff('day', end_day, date) <= {MAX_GAP} AND then_close > 0 THEN round(value * adj_close / then_close, 6) END AS size FROM b""",
)
def asof_strict_size(spark: SparkSession, d: str) -> DataFrame:
    """A measured value, usable strictly after it was filed, grown by the price since measurement."""
    m = roles.monthly(spark, d)
    end = F.last_day(F.add_months("qs", 2))
    floats = m.groupBy("symbol", F.trunc("date", "quarter").alias("qs")).agg(F.avg("adj_close").alias("value")).select("symbol", end.alias("end_day"), F.date_add(end, 45).alias("filed"), "value")
    a = asof.asof_join(m, floats, keys=["symbol"], left_time="date", right_time="filed", values=["end_day", "value"], exact=False, slice_width=1024)
    then = m.select("symbol", F.col("date").alias("then_date"), F.col("adj_close").alias("then_close"))
    b = asof.asof_join(a, then, keys=["symbol"], left_time="end_day", right_time="then_date", values=["then_close"], slice_width=1024)
    fresh = (F.datediff("date", "end_day") <= MAX_GAP) & (F.col("then_close") > 0)
    return b.select("symbol", F.col("date").cast("string").alias("date"), F.when(fresh, F.round(F.col("value") * F.col("adj_close") / F.col("then_close"), 6)).alias("size"))


def asked_days(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ASKED], "day string").select(F.col("day").cast("date").alias("day"))


@catalog.query(
    "membership_as_of",
    f"""WITH {roles.ctes('members', 'calendar')}, asked(day) AS (VALUES {_ASKED_SQL})
SELECT day::VARCHAR AS day, c.snapshot_date::VARCHAR AS snapshot_date, ticker FROM asked JOIN cal_r c ON day >= c.snapshot_date AND (c.next_date IS NULL OR day < c.next_date)
JOIN members_r m ON m.snapshot_date = c.snapshot_date WHERE ticker IS NOT NULL""",
)
def membership_as_of(spark: SparkSession, d: str) -> DataFrame:
    out = pit.members_as_of(asked_days(spark), roles.members(spark, d), day="day", date="snapshot_date", member="ticker")
    return out.select(F.col("day").cast("string").alias("day"), F.col("snapshot_date").cast("string").alias("snapshot_date"), "ticker")


@catalog.query(
    "membership_in_period",
    f"""WITH {roles.ctes('members')} SELECT snapshot_date::VARCHAR AS snapshot_date, ticker FROM members_r
WHERE snapshot_date BETWEEN (SELECT max(snapshot_date) FROM members_r WHERE snapshot_date <= DATE '2015-01-01') AND DATE '2017-12-31' AND ticker IS NOT NULL""",
)
def membership_in_period(spark: SparkSession, d: str) -> DataFrame:
    out = pit.snapshots_in_period(roles.members(spark, d), "snapshot_date", "2015-01-01", "2017-12-31").where("ticker IS NOT NULL")
    return out.select(F.col("snapshot_date").cast("string").alias("snapshot_date"), "ticker")


WINDOWS_SQL = f"""windows_r AS (
  SELECT ticker, min(snapshot_date) AS first_day, max(least(coalesce(next_date - 1, DATE '{LAST_DAY}'), DATE '{LAST_DAY}')) AS last_day
  FROM members_r JOIN cal_r USING (snapshot_date) WHERE ticker IS NOT NULL GROUP BY ticker)"""


def windows(spark: SparkSession, d: str) -> DataFrame:
    return pit.member_windows(roles.members(spark, d), date="snapshot_date", member="ticker", end=LAST_DAY)


@catalog.query("ticker_windows", f"WITH {roles.ctes('members', 'calendar')}, {WINDOWS_SQL} SELECT ticker, first_day::VARCHAR AS first_day, last_day::VARCHAR AS last_day FROM windows_r")
def ticker_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows(spark, d).select("ticker", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"))


VALID_SQL = """n_r AS (SELECT ticker, count(*) AS n FROM ranges_r GROUP BY ticker),
{out} AS (SELECT a.ticker, a.day, r.cik, r.yahoo_symbol FROM (SELECT DISTINCT ticker, day FROM {asked}) a JOIN n_r USING (ticker) JOIN ranges_r r USING (ticker)
  WHERE n = 1 OR ((r.valid_from IS NULL OR r.valid_from <= a.day) AND (r.valid_to IS NULL OR r.valid_to >= a.day))
  QUALIFY row_number() OVER (PARTITION BY a.ticker, a.day ORDER BY
    CASE WHEN (r.valid_from IS NULL OR r.valid_from <= a.day) AND (r.valid_to IS NULL OR r.valid_to >= a.day) THEN 0 ELSE 1 END,
    coalesce(r.valid_from, DATE '0001-01-01'), coalesce(r.valid_to, DATE '9999-12-31'), r.cik, r.yahoo_symbol NULLS FIRST) = 1)"""


def resolved(asked: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    r = roles.ranges(spark, d).withColumns(
        {"o1": F.coalesce("valid_from", F.lit(normal.MIN_DAY).cast("date")), "o2": F.coalesce("valid_to", F.lit(normal.MAX_DAY).cast("date"))}
    )
    return pit.resolve_validity(asked, r, key="ticker", day="day", valid_from="valid_from", valid_to="valid_to", order=["o1", "o2", "cik", "yahoo_symbol"], values=["cik", "yahoo_symbol"])


_ASKED_MEMBERS = f"""asked(day) AS (VALUES {_ASKED_SQL}),
on_day AS (SELECT day, ticker FROM asked JOIN cal_r c ON day >= c.snapshot_date AND (c.next_date IS NULL OR day < c.next_date)
  JOIN members_r m ON m.snapshot_date = c.snapshot_date WHERE ticker IS NOT NULL)"""


def _members_on_asked(spark: SparkSession, d: str) -> DataFrame:
    return pit.members_as_of(asked_days(spark), roles.members(spark, d), day="day", date="snapshot_date", member="ticker").select("day", "ticker")


@catalog.query(
    "validity_lookup",
    f"""WITH {roles.ctes('members', 'calendar', 'ranges')}, {_ASKED_MEMBERS}, {VALID_SQL.format(out='v', asked='on_day')}
SELECT o.ticker, o.day::VARCHAR AS day, v.cik, v.yahoo_symbol FROM on_day o LEFT JOIN v ON v.ticker = o.ticker AND v.day = o.day""",
)
def validity_lookup(spark: SparkSession, d: str) -> DataFrame:
    return resolved(_members_on_asked(spark, d), spark, d).select("ticker", F.col("day").cast("string").alias("day"), "cik", "yahoo_symbol")


@catalog.query(
    "member_companies",
    f"""WITH {roles.ctes('members', 'calendar', 'ranges')}, {_ASKED_MEMBERS}, {VALID_SQL.format(out='v', asked='on_day')}
SELECT day::VARCHAR AS day, cik, count(*) AS n_tickers, min(ticker) AS first_ticker FROM v GROUP BY day, cik""",
)
def member_companies(spark: SparkSession, d: str) -> DataFrame:
    out = resolved(_members_on_asked(spark, d), spark, d).where("cik IS NOT NULL").groupBy("day", "cik").agg(F.count(F.lit(1)).alias("n_tickers"), F.min("ticker").alias("first_ticker"))
    return out.withColumn("day", F.col("day").cast("string"))


UNIVERSE_SQL = f"""days_r AS (SELECT DISTINCT date_filed AS day FROM filings_r WHERE date_filed IS NOT NULL),
day_members AS (SELECT day, ticker FROM days_r JOIN cal_r c ON day >= c.snapshot_date AND (c.next_date IS NULL OR day < c.next_date)
  JOIN members_r m ON m.snapshot_date = c.snapshot_date WHERE ticker IS NOT NULL),
{VALID_SQL.format(out='held', asked='day_members')},
firms AS (SELECT day, cik, arg_min(coalesce(yahoo_symbol, ''), ticker) AS symbol, min(ticker) AS ticker FROM held GROUP BY day, cik),
universe_r AS (SELECT f.accession, f.cik, f.t, f.date_filed, ticker, nullif(symbol, '') AS symbol FROM filings_r f JOIN firms ON f.date_filed = firms.day AND f.cik = firms.cik
  QUALIFY row_number() OVER (PARTITION BY f.accession ORDER BY f.cik) = 1)"""


def universe(spark: SparkSession, d: str) -> DataFrame:
    """Filings of companies that were members on the day of filing; the first ticker's symbol, one row per accession.

    A filing meets only the tickers its own company may hold, and of those only the ones in the
    snapshot in force; which company a ticker meant that day is then settled for these few alone,
    so nothing is made per day and member.
    """
    f, r, m = roles.filings(spark, d), roles.ranges(spark, d), roles.members(spark, d).where("ticker IS NOT NULL")
    asked = f.select(F.col("date_filed").alias("day"), "cik").where("day IS NOT NULL").distinct().join(pit.in_force(f.select(F.col("date_filed").alias("day")), roles.members(spark, d), day="day", date="snapshot_date"), "day")
    may_hold = asked.join(r.select("cik", "ticker").distinct(), "cik").join(m, ["snapshot_date", "ticker"], "left_semi")
    held = resolved(may_hold.select("ticker", "day", F.col("cik").alias("asked_cik")), spark, d).where("cik = asked_cik")
    firms = held.groupBy("day", "cik").agg(F.min(F.struct("ticker", "yahoo_symbol")).alias("m"))
    joined = f.join(firms.select(F.col("day").alias("date_filed"), "cik", "m.ticker", F.col("m.yahoo_symbol").alias("symbol")), ["date_filed", "cik"])
    return pit.first_of(joined, ["accession"], ["cik"]).select("accession", "cik", "t", "date_filed", "ticker", "symbol")


@catalog.query("universe_filings", f"WITH {roles.ctes('filings', 'members', 'calendar', 'ranges')}, {UNIVERSE_SQL} SELECT accession, cik, date_filed::VARCHAR AS date_filed, ticker, symbol FROM universe_r")
def universe_filings(spark: SparkSession, d: str) -> DataFrame:
    return universe(spark, d).select("accession", "cik", F.col("date_filed").cast("string").alias("date_filed"), "ticker", "symbol")


_NAME_SQL = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower({c}), '&', ' and '), '/[a-z]{{2,4}}/?', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'),
  '\\b(?:the|inc|incorporated|corp|corporation|co|company|companies|ltd|limited|plc|llc|lp|l\\s?p|n\\s?v|s\\s?a|ag|se|holdings?|group|international|intl|trust|bancorp)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"""


@catalog.query("company_names", f"SELECT company, count(*) AS n, {_NAME_SQL.format(c='company')} AS norm_name FROM filings WHERE company IS NOT NULL GROUP BY company")
def company_names(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "filings").where("company IS NOT NULL").groupBy("company").agg(F.count(F.lit(1)).alias("n"))
    return f.withColumn("norm_name", text.company_name(F.col("company")))


RESOLVE_SQL = f"""act AS (SELECT DISTINCT cik, date_filed, {_NAME_SQL.format(c='company')} AS norm_name FROM filings WHERE cik IS NOT NULL AND date_filed IS NOT NULL),
review_r AS (SELECT {roles.TICKER_SQL} AS ticker, cik, match_source FROM ticker_map_review),
cand AS (
  SELECT r.ticker, coalesce(r.valid_from, w.first_day) AS valid_from, coalesce(r.valid_to, w.last_day) AS valid_to, r.cik, 'override' AS src, 0 AS prio, true AS sure FROM windows_r w JOIN ranges_r r USING (ticker)
  UNION ALL SELECT w.ticker, first_day, last_day, min(v.cik), 'wikipedia', 1, false FROM windows_r w JOIN review_r v ON v.ticker = w.ticker AND v.match_source = 'wikipedia' AND v.cik IS NOT NULL GROUP BY ALL
  UNION ALL SELECT w.ticker, first_day, last_day, min(v.cik), 'sec', 2, false FROM windows_r w JOIN review_r v ON v.ticker = w.ticker AND v.match_source = 'sec' AND v.cik IS NOT NULL GROUP BY ALL),
near AS (SELECT * FROM cand c WHERE sure OR EXISTS (SELECT 1 FROM act a WHERE a.cik = c.cik AND a.date_filed BETWEEN c.valid_from - {WINDOW_DAYS} AND c.valid_to + {WINDOW_DAYS})),
vendor_r AS (SELECT {roles.TICKER_SQL.replace('ticker', 'symbol')} AS ticker, min({_NAME_SQL.format(c='issuer_name')}) AS norm_name FROM vendor_issuers WHERE symbol IS NOT NULL AND issuer_name IS NOT NULL GROUP BY 1),
named AS (SELECT w.ticker, w.first_day, w.last_day, min(a.cik) AS cik FROM windows_r w JOIN vendor_r v USING (ticker) JOIN act a ON a.norm_name = v.norm_name
  AND a.date_filed BETWEEN w.first_day - {WINDOW_DAYS} AND w.last_day + {WINDOW_DAYS} GROUP BY ALL HAVING count(DISTINCT a.cik) = 1),
allc AS (SELECT ticker, valid_from, valid_to, cik, src, prio FROM near UNION ALL SELECT ticker, first_day, last_day, cik, 'name', 3 FROM named),
best AS (SELECT * FROM allc QUALIFY prio = min(prio) OVER (PARTITION BY ticker)),
map_r AS (SELECT w.ticker, coalesce(b.valid_from, w.first_day) AS valid_from, coalesce(b.valid_to, w.last_day) AS valid_to, b.cik, b.src AS match_source FROM windows_r w LEFT JOIN best b USING (ticker))"""


def resolution(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The parts of a ticker's resolution: ``windows``, hand-checked ranges (``sure``), listed owners
    (``auto``) and those of them that filed near the membership (``near``), and what a name hits (``names``)."""
    w = windows(spark, d)
    f = load(spark, d, "filings").where("cik IS NOT NULL AND date_filed IS NOT NULL")
    act = f.select("cik", "date_filed", text.company_name(F.col("company")).alias("norm_name")).distinct()
    sure = w.join(roles.ranges(spark, d), "ticker").select(
        "ticker", F.coalesce("valid_from", "first_day").alias("valid_from"), F.coalesce("valid_to", "last_day").alias("valid_to"), "cik", F.lit("override").alias("match_source"), F.lit(0).alias("prio")
    )
    review = load(spark, d, "ticker_map_review").select(normal.ticker(F.col("ticker")).alias("ticker"), "cik", "match_source").where("cik IS NOT NULL AND match_source IN ('wikipedia', 'sec')")
    listed = review.groupBy("ticker", "match_source").agg(F.min("cik").alias("cik")).withColumn("prio", F.when(F.col("match_source") == "wikipedia", 1).otherwise(2))
    auto = w.join(listed, "ticker").select("ticker", F.col("first_day").alias("valid_from"), F.col("last_day").alias("valid_to"), "cik", "match_source", "prio")
    near = pit.near_window(auto, act, key="cik", first="valid_from", last="valid_to", at="date_filed", pad_days=WINDOW_DAYS)
    vendor = load(spark, d, "vendor_issuers").where("symbol IS NOT NULL AND issuer_name IS NOT NULL").groupBy(normal.ticker(F.col("symbol")).alias("ticker")).agg(F.min(text.company_name(F.col("issuer_name"))).alias("norm_name"))
    close = (F.col("date_filed") >= F.date_sub("first_day", WINDOW_DAYS)) & (F.col("date_filed") <= F.date_add("last_day", WINDOW_DAYS))
    hits = (
        w.join(vendor, "ticker").join(act, "norm_name").where(close)
        .groupBy("ticker", F.col("first_day").alias("valid_from"), F.col("last_day").alias("valid_to")).agg(F.min("cik").alias("cik"), F.count_distinct("cik").alias("n_hits"))
    )
    return {"windows": w, "sure": sure, "auto": auto, "near": near, "names": hits, "vendor": vendor}


def ticker_map(spark: SparkSession, d: str) -> DataFrame:
    """Which company a member ticker meant: hand-checked ranges first, then listed owners that filed
    near the membership, then a single filer of that normalised name."""
    r = resolution(spark, d)
    w, named = r["windows"], r["names"].where("n_hits = 1").select("ticker", "valid_from", "valid_to", "cik", F.lit("name").alias("match_source"), F.lit(3).alias("prio"))
    every = r["sure"].unionByName(r["near"]).unionByName(named)
    best = every.withColumn("_b", F.min("prio").over(W.partitionBy("ticker"))).where("prio = _b").drop("_b", "prio")
    return w.join(best, "ticker", "left").select("ticker", F.coalesce("valid_from", "first_day").alias("valid_from"), F.coalesce("valid_to", "last_day").alias("valid_to"), "cik", "match_source")


_RESOLVE_CTES = f"{roles.ctes('members', 'calendar', 'ranges')}, {WINDOWS_SQL}, {RESOLVE_SQL}"


@catalog.query("entity_resolution", f"WITH {_RESOLVE_CTES} SELECT ticker, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to, cik, match_source FROM map_r")
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    return ticker_map(spark, d).withColumns({"valid_from": F.col("valid_from").cast("string"), "valid_to": F.col("valid_to").cast("string")})


@catalog.query(
    "resolution_notes",
    f"""WITH {_RESOLVE_CTES}, got AS (SELECT ticker, min(prio) AS prio FROM near GROUP BY ticker),
failed AS (SELECT c.ticker, c.prio, c.src || ' CIK ' || c.cik || ' did not file near membership' AS note FROM cand c LEFT JOIN got g USING (ticker) WHERE NOT c.sure AND (g.prio IS NULL OR c.prio < g.prio)
  AND NOT EXISTS (SELECT 1 FROM near n WHERE n.ticker = c.ticker AND n.prio = c.prio)),
hits AS (SELECT w.ticker, any_value(v.norm_name) AS norm_name, count(DISTINCT a.cik) AS n FROM windows_r w JOIN vendor_r v USING (ticker) LEFT JOIN act a ON a.norm_name = v.norm_name AND a.date_filed BETWEEN w.first_day - {WINDOW_DAYS} AND w.last_day + {WINDOW_DAYS} GROUP BY w.ticker),
notes AS (FROM failed UNION ALL SELECT h.ticker, 3, 'name ' || chr(39) || norm_name || chr(39) || ' matched ' || n || ' filers' FROM hits h LEFT JOIN got g USING (ticker) WHERE g.prio IS NULL AND n <> 1)
SELECT ticker, string_agg(note, '; ' ORDER BY prio) AS note FROM notes GROUP BY ticker""",
)
def resolution_notes(spark: SparkSession, d: str) -> DataFrame:
    """Why the candidates tried before the one taken, or all of them, were passed over."""
    r = resolution(spark, d)
    got = r["sure"].select("ticker", "prio").unionByName(r["near"].select("ticker", "prio")).groupBy("ticker").agg(F.min("prio").alias("got"))
    failed = r["auto"].join(r["near"].select("ticker", "prio").distinct(), ["ticker", "prio"], "left_anti").join(got, "ticker", "left").where("got IS NULL OR prio < got")
    failed = failed.select("ticker", "prio", F.concat("match_source", F.lit(" CIK "), F.col("cik").cast("string"), F.lit(" did not file near membership")).alias("note"))
    asked = r["windows"].select("ticker").join(r["vendor"], "ticker").join(r["names"].groupBy("ticker").agg(F.max("n_hits").alias("n")), "ticker", "left").join(got, "ticker", "left_anti")
    n = F.coalesce("n", F.lit(0))
    named = asked.where(n != 1).select("ticker", F.lit(3).alias("prio"), F.concat(F.lit("name '"), "norm_name", F.lit("' matched "), n.cast("string"), F.lit(" filers")).alias("note"))
    notes = failed.unionByName(named).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("prio", "note"))).alias("n"))  # three notes at most
    return notes.select("ticker", F.concat_ws("; ", F.col("n.note")).alias("note"))


@catalog.query(
    "filing_counts",
    "SELECT form_type, count(*) AS rows_listed, count(DISTINCT accession) AS filings, count(DISTINCT cik) AS companies, count(DISTINCT (accession, cik)) AS registrations FROM filings GROUP BY form_type",
)
def filing_counts(spark: SparkSession, d: str) -> DataFrame:
    """Exact distinct counts, each as a distinct of its own before the count, so that no group gathers its values."""
    f = load(spark, d, "filings").select("form_type", "accession", "cik")
    out = f.groupBy("form_type").agg(F.count(F.lit(1)).alias("rows_listed"))
    for name, cols in (("filings", ["accession"]), ("companies", ["cik"]), ("registrations", ["accession", "cik"])):
        present = f.where(F.coalesce(*cols).isNotNull()) if len(cols) == 1 else f
        n = present.select("form_type", *cols).distinct().groupBy(F.col("form_type").alias("_f")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, F.col("form_type").eqNullSafe(F.col("_f")), "left").drop("_f").na.fill(0, [name])
    return out


@catalog.query(
    "map_review",
    f"""WITH {_RESOLVE_CTES}, span AS (SELECT cik, min(date_filed) AS lo, max(date_filed) AS hi FROM filings WHERE cik IS NOT NULL GROUP BY cik)
SELECT ticker, cik, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to, CASE WHEN lo IS NULL THEN 'none' WHEN lo > valid_from + {WINDOW_DAYS} THEN 'late' ELSE 'early' END AS issue
FROM map_r LEFT JOIN span USING (cik) WHERE cik IS NOT NULL AND (lo IS NULL OR lo > valid_from + {WINDOW_DAYS} OR hi < valid_to - {WINDOW_DAYS})""",
)
def map_review(spark: SparkSession, d: str) -> DataFrame:
    span = load(spark, d, "filings").where("cik IS NOT NULL").groupBy("cik").agg(F.min("date_filed").alias("lo"), F.max("date_filed").alias("hi"))
    late, early = F.col("lo") > F.date_add("valid_from", WINDOW_DAYS), F.col("hi") < F.date_sub("valid_to", WINDOW_DAYS)
    m = ticker_map(spark, d).where("cik IS NOT NULL").join(span, "cik", "left").where(F.col("lo").isNull() | late | early)
    issue = F.when(F.col("lo").isNull(), "none").when(late, "late").otherwise("early")
    return m.select("ticker", "cik", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"), issue.alias("issue"))


@catalog.query(
    "symbol_resolution",
    f"""WITH {_RESOLVE_CTES},
listed AS (SELECT DISTINCT cik, {roles.TICKER_SQL.replace('ticker', 'symbol')} AS ticker FROM filings WHERE cik IS NOT NULL AND symbol IS NOT NULL),
first_of AS (SELECT cik, min(ticker) AS main FROM listed GROUP BY cik), owned AS (SELECT DISTINCT ticker, true AS taken FROM listed),
yahoo AS (SELECT ticker, cik, min(yahoo_symbol) AS manual FROM ranges_r WHERE yahoo_symbol IS NOT NULL GROUP BY ALL)
SELECT m.ticker, m.cik, m.valid_from::VARCHAR AS valid_from,
  CASE WHEN manual IS NOT NULL THEN nullif(manual, '-') WHEN m.cik IS NULL THEN NULL WHEN s.ticker IS NOT NULL THEN replace(m.ticker, '.', '-')
       WHEN main IS NOT NULL THEN replace(main, '.', '-') WHEN taken THEN NULL ELSE replace(m.ticker, '.', '-') END AS symbol
FROM map_r m LEFT JOIN yahoo y ON y.ticker = m.ticker AND y.cik = m.cik LEFT JOIN listed s ON s.ticker = m.ticker AND s.cik = m.cik
LEFT JOIN first_of f ON f.cik = m.cik LEFT JOIN owned o ON o.ticker = m.ticker""",
)
def symbol_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The symbol a range is priced under: hand-set, its own ticker, the company's first, or its old one if free."""
    listed = load(spark, d, "filings").where("cik IS NOT NULL AND symbol IS NOT NULL").select("cik", normal.ticker(F.col("symbol")).alias("ticker")).distinct()
    manual = roles.ranges(spark, d).where("yahoo_symbol IS NOT NULL").groupBy("ticker", "cik").agg(F.min("yahoo_symbol").alias("manual"))
    m = (
        ticker_map(spark, d).join(manual, ["ticker", "cik"], "left").join(listed.withColumn("own", F.lit(True)), ["ticker", "cik"], "left")
        .join(listed.groupBy("cik").agg(F.min("ticker").alias("main")), "cik", "left").join(listed.select("ticker").distinct().withColumn("taken", F.lit(True)), "ticker", "left")
    )
    dashed = lambda c: F.translate(c, ".", "-")
    symbol = (
        F.when(F.col("manual").isNotNull(), F.nullif("manual", F.lit("-"))).when(F.col("cik").isNull(), None).when(F.col("own"), dashed("ticker"))
        .when(F.col("main").isNotNull(), dashed("main")).when(F.col("taken"), None).otherwise(dashed("ticker"))
    )
    return m.select("ticker", "cik", F.col("valid_from").cast("string").alias("valid_from"), symbol.alias("symbol"))


@catalog.query(
    "symbol_vetting",
    f"""WITH {roles.ctes('daily', 'ranges')}, span AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM daily_r GROUP BY symbol),
tm AS (SELECT ticker, cik, coalesce(valid_from, DATE '0001-01-01') AS a, coalesce(valid_to, DATE '9999-12-31') AS b, cik % (SELECT count(*) FROM supplier) + 1 AS symbol FROM ranges_r),
v AS (SELECT tm.*, coalesce(lo > b OR hi < a, false) AS bad FROM tm LEFT JOIN span USING (symbol))
SELECT symbol, count(*) AS n_ranges, sum(bad::INT)::BIGINT AS n_bad, NOT bool_and(bad) AS kept FROM v GROUP BY symbol""",
)
def symbol_vetting(spark: SparkSession, d: str) -> DataFrame:
    """Series that overlap none of the ranges they are meant for are rejected; one good range keeps a symbol."""
    span = roles.daily(spark, d).groupBy("symbol").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    tm = with_symbol(roles.ranges(spark, d), spark, d)
    a, b = F.coalesce("valid_from", F.lit(normal.MIN_DAY).cast("date")), F.coalesce("valid_to", F.lit(normal.MAX_DAY).cast("date"))
    v = tm.join(span, "symbol", "left").withColumn("bad", F.coalesce((F.col("lo") > b) | (F.col("hi") < a), F.lit(False)))
    return v.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_ranges"), F.sum(F.col("bad").cast("int")).alias("n_bad"), (~F.bool_and("bad")).alias("kept"))


def with_symbol(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """The supplier that stands in for a company's price series."""
    return df.withColumn("symbol", F.col("cik") % load(spark, d, "supplier").count() + 1)


@catalog.query(
    "document_scope",
    f"""WITH {roles.ctes('filings', 'members', 'calendar', 'ranges')}, {UNIVERSE_SQL},
span AS (SELECT cik, min(date_filed) AS lo, max(date_filed) AS hi FROM universe_r GROUP BY cik)
SELECT DISTINCT accession, cik FROM (SELECT f.accession, f.cik FROM filings_r f JOIN span s ON f.cik = s.cik AND f.date_filed BETWEEN s.lo - {MAX_GAP} AND s.hi UNION ALL SELECT accession, cik FROM universe_r)""",
)
def document_scope(spark: SparkSession, d: str) -> DataFrame:
    """Universe filings and the earlier ones of their companies that a change signal may look back to."""
    u = universe(spark, d).select("accession", "cik", "date_filed")
    span = u.groupBy("cik").agg(F.min("date_filed").alias("lo"), F.max("date_filed").alias("hi"))
    f = roles.filings(spark, d).join(span, "cik").where((F.col("date_filed") >= F.date_sub("lo", MAX_GAP)) & (F.col("date_filed") <= F.col("hi")))
    return f.select("accession", "cik").unionByName(u.select("accession", "cik")).distinct()
