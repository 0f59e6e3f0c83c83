"""Text, signal, statistics and source queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import Catalog
from tidemark.config import DEFAULTS
from tidemark.functions import normal
from tidemark.operators import documents, excerpts, masking, portfolio, ranking, statistics, wordlists
from tidemark.plans import lookups, roles, study
from tidemark.session import pin, stage
from tidemark.sources import parsers, sinks
from tidemark.sources.tables import load, load_texts

catalog = Catalog()
MAX_RATIO = 3.0

# A small dated word list; code > 0 added in that year, < 0 removed in it.
MASTER = [
    ("DECLINED", 2009, 0), ("FELL", 2009, 0), ("WEAKENED", 2009, 0), ("CONTRACTED", 2009, 0), ("SLOWED", 2014, 0), ("SHUT", 2011, 0), ("SHORTAGE", 2014, 0), ("THREAT", 2016, 0),
    ("SUFFER", 2009, 0), ("FAIL", 2009, 0), ("DISPUTE", -2018, 0), ("LITIGATION", 2009, 0), ("IMPAIRMENT", 2009, 0), ("UNCERTAIN", 2009, 2009), ("MAY", 0, 2009), ("MIGHT", 0, 2009),
    ("COULD", 0, 2012), ("ASSUMES", 0, 2009), ("BELIEVES", 0, 2015), ("ANTICIPATES", 0, -2017), ("ESTIMATES", 0, 2009), ("REVENUE", 0, 0), ("COST", 0, 0), ("EXPENSE", 0, 0), ("INCOME", 0, 0),
    ("MARGIN", 0, 0), ("SEGMENT", 0, 0), ("BOARD", 0, 0), ("COMPANY", 0, 0), ("PLAN", 0, 0), ("CASH", 0, 0), ("FLOW", 0, 0), ("THE", 0, 0), ("OF", 0, 0), ("IN", 0, 0), ("AND", 0, 0), ("TO", 0, 0), ("NA", 0, 0),
]
_MASTER_SQL = "master(word, negative, uncertainty) AS (VALUES " + ", ".join(f"('{w}', {n}, {u})" for w, n, u in MASTER) + """),
lex AS (SELECT word, category, CASE WHEN code > 0 THEN 'a' ELSE 'r' END AS kind, abs(code) AS year
        FROM (SELECT word, 'negative' AS category, negative AS code FROM master UNION ALL SELECT word, 'uncertainty', uncertainty FROM master) WHERE code <> 0)"""
_SECTIONS_SQL = """sections_r AS (SELECT accession, cik, arg_min(text, doc_id) AS text FROM documents
  WHERE section = 'item7' AND accession IS NOT NULL AND cik IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL GROUP BY accession, cik)"""
_COUNTS_SQL = """words_r AS (SELECT accession, cik, upper(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM sections_r),
seen_r AS (SELECT accession, cik, word, count(*) AS c FROM words_r JOIN (SELECT word FROM master) USING (word) GROUP BY ALL),
totals_r AS (SELECT accession, cik, sum(c)::BIGINT AS n_words FROM seen_r GROUP BY ALL),
cohorts_r AS (SELECT accession, cik, category, kind, year, sum(c)::BIGINT AS cnt FROM seen_r JOIN lex USING (word) GROUP BY ALL)"""


def sections(spark: SparkSession, d: str) -> DataFrame:
    """One management discussion per filing: the document with the smallest id."""
    docs = load(pin(spark), d, "documents").where("section = 'item7' AND accession IS NOT NULL AND cik IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    return docs.groupBy("accession", "cik").agg(F.min_by("text", "doc_id").alias("text"))


def lexicon(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    master = spark.createDataFrame(MASTER, "Word string, Negative int, Uncertainty int")
    return master.select(F.col("Word").alias("word")), parsers.lexicon(master, ["negative", "uncertainty"])


def counts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Word counts of every filing's management discussion.

    All such documents are counted where they lie and those of smallest id are picked by their
    counts, so no text is shuffled to find out which one counts.
    """
    vocabulary, lex = lexicon(spark)
    docs = load(pin(spark), d, "documents").where("section = 'item7' AND accession IS NOT NULL AND cik IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    first = docs.groupBy("accession", "cik").agg(F.min("doc_id").alias("doc_id"))
    both = wordlists.cohort_counts(docs, vocabulary, lex, ident=["accession", "cik", "doc_id"], text="text")
    totals, cohorts = (t.join(first, ["accession", "cik", "doc_id"], "left_semi").drop("doc_id") for t in both)
    return totals, cohorts


@catalog.query("lexicon_cohorts", f"WITH {_MASTER_SQL} SELECT word, category, kind, year FROM lex")
def lexicon_cohorts(spark: SparkSession, d: str) -> DataFrame:
    return lexicon(pin(spark))[1]


@catalog.query("lm_cohort_counts", f"WITH {_MASTER_SQL}, {_SECTIONS_SQL}, {_COUNTS_SQL} SELECT accession, cik, category, kind, year, cnt, n_words FROM cohorts_r JOIN totals_r USING (accession, cik)")
def lm_cohort_counts(spark: SparkSession, d: str) -> DataFrame:
    totals, cohorts = counts(spark, d)
    return cohorts.join(totals, ["accession", "cik"])


_LIVE = "CASE WHEN kind = 'a' THEN year < {y} ELSE {y} <= year END"


def _shares_sql(name: str, years: str) -> str:
    """``years`` has accession, cik, y."""
    return f"""{name} AS (SELECT w.accession, w.cik, w.y, w.category, coalesce(sum(cnt) FILTER (WHERE {_LIVE.format(y='w.y')}), 0) / nullif(any_value(n_words), 0) AS share, any_value(n_words) AS n_words
  FROM (SELECT DISTINCT accession, cik, y, category FROM {years} CROSS JOIN (SELECT DISTINCT category FROM lex)) w
  LEFT JOIN cohorts_r USING (accession, cik, category) LEFT JOIN totals_r USING (accession, cik) GROUP BY w.accession, w.cik, w.y, w.category)"""


_YEARS_SQL = f"years_r AS (SELECT accession, cik, year({roles.NY_SQL.format('t')})::INT AS y FROM filings_r WHERE t IS NOT NULL)"


@catalog.query(
    "lm_shares",
    f"""WITH {roles.ctes('filings')}, {_MASTER_SQL}, {_SECTIONS_SQL}, {_COUNTS_SQL}, {_YEARS_SQL}, {_shares_sql('shares_r', '(SELECT y.* FROM years_r y JOIN totals_r USING (accession, cik))')}
SELECT accession, cik, y AS year_at, category, round(share, 8) AS share FROM shares_r""",
)
def lm_shares(spark: SparkSession, d: str) -> DataFrame:
    totals, cohorts = counts(spark, d)
    f = roles.filings(spark, d).where("t IS NOT NULL").join(totals.select("accession", "cik"), ["accession", "cik"], "left_semi")
    years = _by_category(f.select("accession", "cik", F.year(normal.day_in_zone(F.col("t"))).alias("year_at")))
    s = wordlists.shares(totals, cohorts, years, ident=["accession", "cik"])
    return s.select("accession", "cik", "year_at", "category", F.round("share", 8).alias("share"))


def _by_category(years: DataFrame) -> DataFrame:
    return years.distinct().withColumn("category", F.explode(F.array(F.lit("negative"), F.lit("uncertainty"))))


_CHANGE_SQL = f"""pair_y AS (SELECT accession, cik, prev_accession, year({roles.NY_SQL.format('t')})::INT AS y FROM prev_r),
{_shares_sql('now_r', '(SELECT accession, cik, y FROM pair_y)')},
{_shares_sql('then_r', '(SELECT prev_accession AS accession, cik, y FROM pair_y WHERE prev_accession IS NOT NULL)')},
change_r AS (SELECT p.accession, p.cik, p.prev_accession, p.y, max(n.n_words) / max(o.n_words) AS ratio, sum(n.share - o.share) AS delta, count(n.share - o.share) AS n_both
  FROM pair_y p LEFT JOIN now_r n USING (accession, cik, y) LEFT JOIN then_r o ON o.accession = p.prev_accession AND o.cik = p.cik AND o.y = p.y AND o.category = n.category GROUP BY ALL),
lm_r AS (SELECT accession, cik, prev_accession, ratio, CASE WHEN n_both = 2 AND NOT (ratio > {MAX_RATIO} OR ratio < 1 / {MAX_RATIO}) THEN delta END AS lm_change FROM change_r)"""
_CHANGE_CTES = f"{roles.ctes('filings')}, {lookups.PREV_SQL}, {_MASTER_SQL}, {_SECTIONS_SQL}, {_COUNTS_SQL}, {_CHANGE_SQL}"


def lm_changes(spark: SparkSession, d: str) -> DataFrame:
    """Change of the word shares against the previous filing, both under the list of the current
    filing's year; null where the lengths differ by more than three times."""
    totals, cohorts = counts(spark, d)
    pairs = lookups.previous_filings(spark, d).withColumn("year_at", F.year(normal.day_in_zone(F.col("t"))))
    ident = ["accession", "cik"]
    old = pairs.where("prev_accession IS NOT NULL").select(F.col("prev_accession").alias("accession"), "cik", "year_at")
    every = wordlists.shares(totals, cohorts, _by_category(pairs.select(*ident, "year_at").unionByName(old)), ident=ident)
    listed = every.groupBy(*ident, "year_at").agg(F.sum("share").alias("share"), F.count("share").alias("known"), F.max("n_words").alias("words"))  # a row per filing and list
    then = listed.select(F.col("accession").alias("prev_accession"), "cik", "year_at", *[F.col(c).alias(f"prev_{c}") for c in ("share", "known", "words")])
    both = pairs.join(listed, [*ident, "year_at"], "left").join(then, ["prev_accession", "cik", "year_at"], "left")
    ratio = F.col("words") / F.col("prev_words")
    whole = (F.col("known") == 2) & (F.col("prev_known") == 2) & (ratio <= MAX_RATIO) & (ratio >= 1 / MAX_RATIO)
    return both.select(*ident, "prev_accession", ratio.alias("ratio"), F.when(whole, F.col("share") - F.col("prev_share")).alias("lm_change"))


@catalog.query("lm_change", f"WITH {_CHANGE_CTES} SELECT accession, cik, prev_accession, round(ratio, 6) AS length_ratio, round(lm_change, 8) + 0.0 AS lm_change FROM lm_r")
def lm_change(spark: SparkSession, d: str) -> DataFrame:
    return lm_changes(spark, d).select("accession", "cik", "prev_accession", F.round("ratio", 6).alias("length_ratio"), (F.round("lm_change", 8) + 0.0).alias("lm_change"))


_SCORES_SQL = """scores_r AS (SELECT accession, min(tone) AS tone, min(hedging) AS hedging, min(risk_severity) AS risk, (min(hedging) + min(risk_severity) - min(tone)) / 3 AS pessimism
  FROM signals_r WHERE accession IS NOT NULL GROUP BY accession)"""


@catalog.query(
    "llm_change",
    f"""WITH {roles.ctes('filings', 'signals')}, {lookups.PREV_SQL}, {_SCORES_SQL}
SELECT p.accession, p.cik, round(n.tone - o.tone, 6) + 0.0 AS d_tone, round(n.hedging - o.hedging, 6) + 0.0 AS d_hedging, round(n.risk - o.risk, 6) + 0.0 AS d_risk, round(n.pessimism - o.pessimism, 6) + 0.0 AS llm_change
FROM prev_r p LEFT JOIN scores_r n ON n.accession = p.accession LEFT JOIN scores_r o ON o.accession = p.prev_accession""",
)
def llm_change(spark: SparkSession, d: str) -> DataFrame:
    s = roles.signals(spark, d).where("accession IS NOT NULL").groupBy("accession").agg(F.min("tone").alias("tone"), F.min("hedging").alias("hedging"), F.min("risk_severity").alias("risk"))
    s = s.withColumn("pessimism", (F.col("hedging") + F.col("risk") - F.col("tone")) / 3)
    cols = ["tone", "hedging", "risk", "pessimism"]
    before = s.select(F.col("accession").alias("prev_accession"), *[F.col(c).alias(f"prev_{c}") for c in cols])
    p = lookups.previous_filings(spark, d).join(s, "accession", "left").join(before, "prev_accession", "left")
    d_ = lambda c: (F.round(F.col(c) - F.col(f"prev_{c}"), 6) + 0.0)
    return p.select("accession", "cik", d_("tone").alias("d_tone"), d_("hedging").alias("d_hedging"), d_("risk").alias("d_risk"), d_("pessimism").alias("llm_change"))


_UNI_CTES = f"{roles.ctes('filings', 'members', 'calendar', 'ranges')}, {lookups.UNIVERSE_SQL}, {lookups.PREV_SQL}, {_MASTER_SQL}, {_SECTIONS_SQL}, {_COUNTS_SQL}, {_CHANGE_SQL}"


@catalog.query(
    "signal_coverage",
    f"""WITH {_UNI_CTES} SELECT year(date_filed)::INT AS year, count(*) AS n, count(lm_change) AS with_signal, round(count(lm_change) / count(*), 4) AS coverage
FROM universe_r u LEFT JOIN lm_r USING (accession, cik) GROUP BY 1""",
)
def signal_coverage(spark: SparkSession, d: str) -> DataFrame:
    u = lookups.universe(spark, d).join(lm_changes(spark, d).select("accession", "cik", "lm_change"), ["accession", "cik"], "left")
    return u.groupBy(F.year("date_filed").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count("lm_change").alias("with_signal"), F.round(F.count("lm_change") / F.count(F.lit(1)), 4).alias("coverage")
    )


@catalog.query(
    "missing_reasons",
    f"""WITH {_UNI_CTES}, ok AS (SELECT DISTINCT accession FROM sections_r)
SELECT CASE WHEN u.accession NOT IN (FROM ok) THEN 'current_section_missing' WHEN l.prev_accession IS NULL THEN 'no_previous_filing'
            WHEN l.prev_accession NOT IN (FROM ok) THEN 'previous_section_missing' ELSE 'lengths_differ' END AS reason, count(*) AS n
FROM universe_r u LEFT JOIN lm_r l USING (accession, cik) WHERE lm_change IS NULL GROUP BY 1""",
)
def missing_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The first step at which a universe filing without a signal failed."""
    ok = sections(spark, d).select("accession").distinct()
    u = lookups.universe(spark, d).select("accession", "cik").join(lm_changes(spark, d), ["accession", "cik"], "left").where("lm_change IS NULL")
    u = u.join(ok.withColumn("now_ok", F.lit(True)), "accession", "left").join(ok.select(F.col("accession").alias("prev_accession"), F.lit(True).alias("prev_ok")), "prev_accession", "left")
    reason = (
        F.when(F.col("now_ok").isNull(), "current_section_missing").when(F.col("prev_accession").isNull(), "no_previous_filing")
        .when(F.col("prev_ok").isNull(), "previous_section_missing").otherwise("lengths_differ")
    )
    return u.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@catalog.query(
    "forward_paragraphs",
    """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, p, len(list_filter(regexp_split_to_array(p, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS n FROM p)
SELECT doc_id, count(*) FILTER (WHERE n >= 8) AS paragraphs, count(*) FILTER (WHERE n >= 8 AND regexp_matches(p, '\\b(?:expect\\w*|anticipat\\w*|outlook\\w*|believ\\w*)\\b', 'i')) AS forward
FROM w GROUP BY doc_id""",
)
def forward_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    docs = load(pin(spark), d, "documents").where("text IS NOT NULL")
    p = docs.select("doc_id", excerpts.paragraphs(F.col("text")).alias("p"))
    return p.groupBy("doc_id").agg(F.sum(F.size("p")).alias("paragraphs"), F.sum(F.size(F.filter("p", lambda x: x["p"].rlike(excerpts.FORWARD)))).alias("forward"))


_EXCERPT_SQL = """l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, i, l[i] AS p, list_filter(regexp_split_to_array(l[i], '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)),
k AS (SELECT *, len(w) AS n, regexp_matches(p, '\\b(?:expect\\w*|anticipat\\w*|outlook\\w*|believ\\w*)\\b', 'i') AS ahead FROM p WHERE len(w) >= 8),
v AS (SELECT 1 AS m, * FROM k WHERE ahead UNION ALL SELECT 2, * FROM k),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id, m ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before FROM v),
f AS (SELECT doc_id, m, string_agg(CASE WHEN before + n <= 500 THEN p ELSE array_to_string(w[1:500 - before], ' ') END, chr(10) || chr(10) ORDER BY i) AS excerpt, sum(least(n, 500 - before))::INT AS used FROM c WHERE before < 500 GROUP BY doc_id, m)
SELECT d.doc_id, coalesce(CASE WHEN a.used >= 200 THEN a.excerpt ELSE o.excerpt END, '') AS excerpt, CASE WHEN a.used >= 200 THEN 'forward_looking' ELSE 'opening_fallback' END AS method, coalesce(CASE WHEN a.used >= 200 THEN a.used ELSE o.used END, 0) AS tokens
FROM l d LEFT JOIN f a ON a.doc_id = d.doc_id AND a.m = 1 LEFT JOIN f o ON o.doc_id = d.doc_id AND o.m = 2"""


@catalog.query("excerpt", f"WITH {_EXCERPT_SQL}")
def excerpt(spark: SparkSession, d: str) -> DataFrame:
    docs = load(pin(spark), d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", excerpts.excerpt(F.col("text"), 500, 200).alias("e")).select("doc_id", "e.*")


_INSIDE = "{0} IS NOT NULL AND {0} BETWEEN -1 AND 1"


@catalog.query(
    "score_validation",
    f"""WITH s AS (SELECT signal_id, min(tone) AS t, min(hedging) AS h, min(risk_severity) AS r FROM signals WHERE signal_id IS NOT NULL GROUP BY signal_id)
SELECT signal_id, CASE WHEN signal_id % 6 IN (2, 3, 4) THEN false WHEN signal_id % 6 = 5 THEN {_INSIDE.format('t * 10')} AND {_INSIDE.format('h')} AND {_INSIDE.format('r')}
  ELSE {_INSIDE.format('t')} AND {_INSIDE.format('h')} AND {_INSIDE.format('r')} END AS valid FROM s""",
)
def score_validation(spark: SparkSession, d: str) -> DataFrame:
    """Replies written from the scores of every signal - plain, within a sentence, with a key missing, a key
    too many, a number as text, a value ten times as large - and judged."""
    s = load(pin(spark), d, "signals").where("signal_id IS NOT NULL").groupBy("signal_id").agg(*[F.min(c).alias(c) for c in ("tone", "hedging", "risk_severity")])
    keep = {"ignoreNullFields": "false"}
    json = lambda *c: F.to_json(F.struct(*c), keep)
    whole = json("tone", "hedging", "risk_severity")
    kinds = [
        whole, F.concat(F.lit("Here it is: "), whole, F.lit(" as asked.")), json("tone", "hedging"), json("tone", "hedging", "risk_severity", F.lit(0).alias("more")),
        json(F.col("tone").cast("string").alias("tone"), "hedging", "risk_severity"), json((F.col("tone") * 10).alias("tone"), "hedging", "risk_severity"),
    ]
    raw = F.element_at(F.array(*kinds), F.pmod("signal_id", F.lit(6)).cast("int") + 1)
    return s.select("signal_id", excerpts.scores(raw).isNotNull().alias("valid"))


@catalog.query("score_run")
def score_run(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts not yet in the result cache, scored by the deterministic stand-in backend."""
    todo = result_cache_todo(spark, d).join(sections(spark, d), ["accession", "cik"])
    todo = todo.select("accession", excerpts.excerpt(F.col("text"))["excerpt"].alias("excerpt"))
    return excerpts.score_excerpts(todo, excerpts.CountingBackend, ident="accession", text="excerpt").drop("raw_output", "seconds")


_SCORED_SQL = _EXCERPT_SQL.replace("FROM documents", "FROM todo_d")


@catalog.query(
    "scoring_report",
    f"""WITH {_SECTIONS_SQL}, cached AS (SELECT DISTINCT accession FROM signals WHERE accession IS NOT NULL AND prev_acceptance IS NOT NULL),
todo_d AS (SELECT accession || '|' || cik AS doc_id, text FROM sections_r WHERE accession NOT IN (FROM cached)), scored AS (WITH {_SCORED_SQL}),
n AS (SELECT count(*) AS in_scope, count(*) FILTER (WHERE accession IN (FROM cached)) AS cached FROM sections_r)
SELECT any_value(in_scope) AS in_scope, any_value(cached) AS cached, count(doc_id) AS scored, count(doc_id) AS valid, 0::BIGINT AS invalid, round((any_value(cached) + count(doc_id)) / any_value(in_scope), 4) AS valid_share, 0::BIGINT AS needed_retry, any_value(in_scope) - any_value(cached) - count(doc_id) AS unscored,
  count(*) FILTER (WHERE method = 'forward_looking') AS forward_looking, count(*) FILTER (WHERE method = 'opening_fallback') AS opening_fallback, true AS passed FROM n LEFT JOIN scored ON true""",
)
def scoring_report(spark: SparkSession, d: str) -> DataFrame:
    """What a scoring run of all sections found in its cache, scored, had to ask twice and got, against its
    gate; the seconds it took, which no SQL can know, are left out here."""
    every = sections(spark, d)
    cache = load(spark, d, "signals").where("prev_acceptance IS NOT NULL")
    keyed = every.withColumn("key", F.concat_ws("|", "accession", "cik"))
    todo = sinks.not_done(keyed, cache, ["accession"])
    n, new = every.count(), todo.count()
    todo = todo.withColumn("e", excerpts.excerpt(F.col("text"))).select("key", "e.excerpt", "e.method")
    scored = excerpts.score_excerpts(todo, excerpts.CountingBackend, ident="key", text="excerpt", keep=["method"])
    return excerpts.run_report(scored, in_scope=n, cached=n - new, cached_valid=n - new, gate=DEFAULTS["gates"]["scores"]).drop("median_seconds")


@catalog.query("excerpt_audit", "SELECT count(*) AS documents, count(*) AS same_excerpt, 1.0::DOUBLE AS share FROM documents WHERE text IS NOT NULL")
def excerpt_audit(spark: SparkSession, d: str) -> DataFrame:
    """The excerpts made by native expressions against those made with a token counter in workers."""
    docs = load_texts(pin(spark), d, "documents", "doc_id", "text").where("text IS NOT NULL")
    native = docs.select("doc_id", excerpts.excerpt(F.col("text")).alias("e")).select("doc_id", F.md5("e.excerpt").alias("a"), F.col("e.tokens").alias("n"))
    counted = excerpts.select_excerpts(docs, lambda: excerpts.count_words, ident="doc_id", text="text").select("doc_id", F.md5("excerpt").alias("b"), F.col("tokens").alias("m"))
    same = ((F.col("a") == F.col("b")) & (F.col("n") == F.col("m"))).cast("int")
    both = native.groupBy("doc_id", "a", "n").count().join(counted.groupBy("doc_id", "b", "m").agg(F.count(F.lit(1)).alias("k")), "doc_id", "left")
    return both.agg(F.sum("count").alias("documents"), F.sum(F.coalesce(same * F.col("count"), F.lit(0))).alias("same_excerpt"), (F.sum(same * F.col("count")) / F.sum("count")).alias("share"))


@catalog.query("result_cache_todo", f"WITH {_SECTIONS_SQL} SELECT accession, cik FROM sections_r WHERE accession NOT IN (SELECT accession FROM signals WHERE accession IS NOT NULL AND prev_acceptance IS NOT NULL)")
def result_cache_todo(spark: SparkSession, d: str) -> DataFrame:
    cache = load(spark, d, "signals").where("prev_acceptance IS NOT NULL")
    return sinks.not_done(sections(spark, d).select("accession", "cik"), cache, ["accession"])


@catalog.query(
    "cache_upsert",
    """WITH old AS (SELECT DISTINCT accession, 0 AS version FROM signals WHERE accession IS NOT NULL), new AS (SELECT DISTINCT accession, 1 AS version FROM documents WHERE accession IS NOT NULL)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE accession NOT IN (SELECT accession FROM new)""",
)
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = load(pin(spark), d, "signals").where("accession IS NOT NULL").select("accession").distinct().withColumn("version", F.lit(0))
    new = load(spark, d, "documents").where("accession IS NOT NULL").select("accession").distinct().withColumn("version", F.lit(1))
    return sinks.upsert(old, new, ["accession"])


ITEM7, ITEM8 = "Item 7. Management's Discussion and Analysis", "Item 8. Financial Statements and Supplementary Data"


def _extracted(docs: DataFrame) -> DataFrame:
    """Sections cut out of whole filings, each rebuilt as a page around a document's text: by items, by
    items after a list of contents, by titles alone, or with a hidden part and a cross-reference within."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    body = F.concat(F.lit("<p>"), F.regexp_replace(plain, "\n", "</p><p>"), F.lit("</p>"))
    p = lambda *lines: F.lit("".join(f"<p>{x}</p>" for x in lines))
    table = F.lit("<table><tr><td>1,234</td></tr></table>")
    items = [p("Item 1. Business", "We make things.", ITEM7), body, table, p(ITEM8)]
    frames = [
        F.concat(*items), F.concat(p("Item 1. Business 3", ITEM7 + " 20", ITEM8 + " 40"), *items),
        F.concat(p(ITEM7.split(". ")[1]), body, table, p(ITEM8.split(". ")[1])),
        F.concat(*items[:2], F.lit("<div style='display: none'>Item 8. Financial Statements</div>"), p("Item 8 of this report."), *items[2:]),
    ]
    page = F.concat(F.lit("<html><head><title>Item 7</title></head><body>"), F.element_at(F.array(*frames), F.pmod("doc_id", F.lit(4)).cast("int") + 1), F.lit("</body></html>"))
    return documents.extract_sections(docs.select("doc_id", page.alias("html")), ident="doc_id", html="html")


_BLANK = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_EXTRACT_SQL = rf"""lines_x AS (SELECT doc_id, unnest(string_split(replace(replace(replace(text, chr(160), ' '), chr(8203), ''), chr(13), chr(10)), chr(10))) AS l, generate_subscripts(string_split(replace(replace(replace(text, chr(160), ' '), chr(8203), ''), chr(13), chr(10)), chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
words_x AS (SELECT doc_id, i, list_filter(regexp_split_to_array(l, '{_BLANK}'), lambda x: x <> '') AS w FROM lines_x),
kept_x AS (SELECT doc_id, i, array_to_string(w, ' ') AS l, len(w) AS n FROM words_x WHERE len(w) > 0
  AND NOT regexp_matches(array_to_string(w, ' '), '^(?:[-–—\s]*\d{{1,3}}[-–—\s]*|page\s+\d+(?:\s+of\s+\d+)?|table\s+of\s+contents|index)$', 'i')),
body_x AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS body, sum(n)::INT AS n FROM kept_x GROUP BY doc_id),
full_x AS (SELECT doc_id, coalesce(n, 0) + 1 + CASE WHEN doc_id % 4 = 3 THEN 5 ELSE 0 END AS n_words, concat_ws(chr(10), body, CASE WHEN doc_id % 4 = 3 THEN 'Item 8 of this report.' END, '1,234') AS section
  FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) LEFT JOIN body_x USING (doc_id)),
extracted_x AS (SELECT doc_id, n_words::INT AS n_words, CASE WHEN n_words >= 250 THEN CASE WHEN doc_id % 4 = 2 THEN 'title_fallback' ELSE 'item_heading' END END AS method, CASE WHEN n_words >= 250 THEN 'ok' ELSE 'failed' END AS status,
  CASE WHEN n_words >= 250 THEN NULL WHEN regexp_matches(section, 'regulation\s+ab\b', 'i') THEN 'abs_issuer_no_mda' WHEN regexp_matches(section, 'incorporated\s+(?:herein\s+)?by\s+reference|exhibit\s+13', 'i') THEN 'incorporated_by_reference' ELSE 'section_too_short' END AS failure_reason,
  CASE WHEN n_words >= 250 THEN md5(section) END AS digest FROM full_x)"""


@catalog.query("section_extract", f"WITH {_EXTRACT_SQL} SELECT * FROM extracted_x")
def section_extract(spark: SparkSession, d: str) -> DataFrame:
    out = _extracted(load_texts(pin(spark), d, "documents", "doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL"))
    return out.withColumn("digest", F.md5("text")).drop("text")


@catalog.query(
    "section_report",
    f"""WITH {_EXTRACT_SQL}, t AS (SELECT count(*) AS total, round(avg((status = 'ok')::INT), 4) AS coverage, median(n_words) FILTER (WHERE status = 'ok') AS median_words_ok FROM extracted_x)
SELECT status, method, failure_reason, count(*) AS n, median(n_words) AS median_words, any_value(coverage) AS coverage, any_value(median_words_ok) AS median_words_ok, any_value(coverage) >= 0.9 AS passed, round(count(*) / any_value(total), 4) AS share
FROM extracted_x CROSS JOIN t GROUP BY status, method, failure_reason""",
)
def section_report(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of the extraction over all documents, a row per status, method and kind of failure;
    ``coverage`` is the share that succeeded, ``median_words_ok`` its median and ``passed`` whether
    the share reaches its gate, the same in every row."""
    t = stage(section_extract(spark, d), "extracted")  # read by groups and totals
    return extraction_report(t, DEFAULTS["gates"]["sections"])


def extraction_report(t: DataFrame, gate: float) -> DataFrame:
    """Counts of (status, method, failure_reason, n_words) by outcome; of a reason what stands before its colon."""
    t = t.withColumn("failure_reason", F.split_part("failure_reason", F.lit(":"), F.lit(1)))
    by = t.groupBy("status", "method", "failure_reason").agg(F.count(F.lit(1)).alias("n"), F.median("n_words").alias("median_words"))
    ok = F.col("status") == "ok"
    total = t.agg(F.count(F.lit(1)).alias("total"), F.round(F.avg(ok.cast("int")), 4).alias("coverage"), F.median(F.when(ok, F.col("n_words"))).alias("median_words_ok"))
    return by.join(F.broadcast(total.withColumn("passed", F.col("coverage") >= gate))).withColumn("share", F.round(F.col("n") / F.col("total"), 4)).drop("total")  # total: one row


@catalog.query(
    "section_failures",
    f"""WITH {_EXTRACT_SQL}, named AS (SELECT accession, min(company) AS company, min(primary_doc_url) AS url FROM filings WHERE accession IS NOT NULL GROUP BY accession)
SELECT x.doc_id, accession, company, failure_reason, url FROM extracted_x x JOIN (SELECT DISTINCT doc_id, accession FROM documents) USING (doc_id) JOIN named USING (accession) WHERE status = 'failed'""",
)
def section_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failed extractions with the company and address of their filing, for a look by hand."""
    failed = section_extract(spark, d).where("status = 'failed'").select("doc_id", "failure_reason")
    of = load(spark, d, "documents").select("doc_id", "accession").distinct()
    named = load(spark, d, "filings").where("accession IS NOT NULL").groupBy("accession").agg(F.min("company").alias("company"), F.min("primary_doc_url").alias("url"))
    return failed.join(of, "doc_id").join(named, "accession").select("doc_id", "accession", "company", "failure_reason", "url")


_YEAR_SQL = "replace({}, chr(1), '')"


def _date_year_sql() -> str:
    """The patterns without look-around: a year that a figure follows is split by a mark first, twice, as
    neighbours share letters; FY and fiscal are put back."""
    out = "text"
    for p in masking.DATES:
        out = f"regexp_replace({out}, '{p}', '[DATE]', 'g')"
    for _ in range(2):
        for century, decades in (("19", "[5-9]"), ("20", "[0-4]")):
            out = rf"regexp_replace({out}, '\b({century})({decades}\d(?:s\b)?[\d,.]\d)', '\1' || chr(1) || '\2', 'g')"
    out = rf"regexp_replace({out}, '\b(?:19[5-9]\d|20[0-4]\d)(?:s\b)?', '[YEAR]', 'g')"
    out = rf"regexp_replace({_YEAR_SQL.format(out)}, '\bFY(?:20)?\d{{2}}\b', 'FY[YEAR]', 'g')"
    return rf"regexp_replace({out}, '(?i)\b(fiscal )''?\d{{2}}\b', '\1[YEAR]', 'g')"


@catalog.query("date_year_mask", f"SELECT doc_id, md5({_date_year_sql()}) AS digest FROM documents WHERE text IS NOT NULL")
def date_year_mask(spark: SparkSession, d: str) -> DataFrame:
    """Dates and years masked in every document that has a text."""
    docs = load_texts(pin(spark), d, "documents", "doc_id", "text").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(masking.mask_dates(F.col("text"))).alias("digest"))


def identities(spark: SparkSession, d: str) -> DataFrame:
    """(cik, names, tickers): every spelling and symbol a company was seen with."""
    f = load(pin(spark), d, "filings").where("cik IS NOT NULL")
    t = normal.ticker(F.col("symbol"))
    return f.groupBy("cik").agg(F.array_sort(F.collect_set("company")).alias("names"), F.array_sort(F.collect_set(t)).alias("tickers"))


@catalog.query(
    "filing_identities",
    f"SELECT cik, coalesce(string_agg(DISTINCT company, '|' ORDER BY company), '') AS names, coalesce(string_agg(DISTINCT {roles.TICKER_SQL.replace('ticker', 'symbol')}, '|' ORDER BY {roles.TICKER_SQL.replace('ticker', 'symbol')}), '') AS tickers FROM filings WHERE cik IS NOT NULL GROUP BY cik",
)
def filing_identities(spark: SparkSession, d: str) -> DataFrame:
    return identities(spark, d).select("cik", *[F.concat_ws("|", c).alias(c) for c in ("names", "tickers")])


@catalog.query(
    "registrant_identities",
    f"""WITH pairs AS (SELECT DISTINCT accession, cik FROM filings WHERE accession IS NOT NULL AND cik IS NOT NULL),
seen AS (SELECT DISTINCT cik, company, {roles.TICKER_SQL.replace('ticker', 'symbol')} AS ticker FROM filings WHERE cik IS NOT NULL)
SELECT accession, count(DISTINCT cik) AS n_registrants, coalesce(string_agg(DISTINCT company, '|' ORDER BY company), '') AS names, coalesce(string_agg(DISTINCT ticker, '|' ORDER BY ticker), '') AS tickers
FROM pairs JOIN seen USING (cik) GROUP BY accession""",
)
def registrant_identities(spark: SparkSession, d: str) -> DataFrame:
    """Names and tickers of a filing: those of all its co-registrants, each seen anywhere."""
    pairs = load(pin(spark), d, "filings").where("accession IS NOT NULL AND cik IS NOT NULL").select("accession", "cik").distinct()
    union = lambda c: F.concat_ws("|", F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))))  # noqa: E731  (as many lists as registrants)
    return pairs.join(identities(spark, d), "cik").groupBy("accession").agg(F.count(F.lit(1)).alias("n_registrants"), union("names").alias("names"), union("tickers").alias("tickers"))


@catalog.query("entity_mask")
def entity_mask(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its company's names and tickers masked; what leaks through is counted."""
    docs = load_texts(pin(spark), d, "documents", "doc_id", "cik", "text").where("text IS NOT NULL").join(identities(spark, d), "cik", "left")
    out = masking.mask_documents(docs, ident="doc_id", text="text", names="names", tickers="tickers")
    return out.withColumn("masked", F.md5("masked"))


def common_words(docs: DataFrame, most: int = 50_000) -> frozenset[str]:
    """The ``most`` frequent words that stand in lower case, in upper case: what a language uses, whatever
    the number of documents.  The driver reads them as a parameter of the masking."""
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"\b[a-z]{2,}\b"), F.lit(0))).alias("w"))
    top = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").orderBy(F.desc("n"), "w").limit(most)
    return frozenset(r["w"].upper() for r in top.select("w").collect())


@catalog.query("entity_mask_named")
def entity_mask_named(spark: SparkSession, d: str) -> DataFrame:
    """Every document masked with a finder of companies, persons and places and the collection's common words."""
    docs = load_texts(pin(spark), d, "documents", "doc_id", "cik", "text").where("text IS NOT NULL")
    out = masking.mask_documents(
        docs.join(identities(spark, d), "cik", "left"), ident="doc_id", text="text", names="names", tickers="tickers", make_finder=masking.RuleFinder, common=common_words(docs)
    )
    return out.withColumn("masked", F.md5("masked"))


@catalog.query(
    "planted_mask",
    r"""WITH f AS (SELECT accession, cik, min(company) AS company, min(date_filed) AS day FROM filings WHERE accession IS NOT NULL AND cik IS NOT NULL AND date_filed IS NOT NULL AND company IS NOT NULL GROUP BY ALL)
SELECT accession, cik, 'The report of [COMPANY]' || regexp_extract(company, '(\s*(?:/[A-Z]{2,3}/?)?\s*)$', 1) || ' (NYSE: [TICKER]) of [DATE] covers [YEAR] and FY[YEAR]; [TICKER] rose.' AS masked, 1::BIGINT AS n_company, 2::BIGINT AS n_ticker, 1::BIGINT AS n_date, 2::BIGINT AS n_year, 0::BIGINT AS leaks FROM f""",
)
def planted_mask(spark: SparkSession, d: str) -> DataFrame:
    """A sentence written for every filing with its company, ticker, date and years, masked: nothing of it
    may show but the state tag behind a name."""
    f = load(pin(spark), d, "filings").where("accession IS NOT NULL AND cik IS NOT NULL AND date_filed IS NOT NULL AND company IS NOT NULL")
    f = f.groupBy("accession", "cik").agg(F.min("company").alias("company"), F.min("date_filed").alias("day"))
    ticker = F.concat(F.lit("Q"), F.translate(F.substring(F.lpad(F.col("cik").cast("string"), 3, "0"), -3, 3), "0123456789", "ABCDEFGHIJ"))
    text = F.format_string(
        "The report of %s (NYSE: %s) of %s covers %s and FY%s; %s rose.", "company", ticker, F.date_format("day", "MMMM d, yyyy"), F.date_format("day", "yyyy"), F.date_format("day", "yy"), ticker
    )
    rows = f.select(F.struct("accession", "cik").alias("key"), text.alias("text"), F.array("company").alias("names"), F.array(ticker).alias("tickers"))
    rows = rows.withColumn("key", F.to_json("key"))
    out = masking.mask_documents(rows, ident="key", text="text", names="names", tickers="tickers")
    key = F.from_json("key", "accession string, cik bigint")
    return out.select(key.alias("k"), "*").select("k.accession", "k.cik", "masked", "n_company", "n_ticker", "n_date", "n_year", (F.col("leak_name") + F.col("leak_ticker") + F.col("leak_year")).alias("leaks"))


@catalog.query("mask_report")
def mask_report(spark: SparkSession, d: str) -> DataFrame:
    m = entity_mask(spark, d)
    cols = [c for c in m.columns if c.startswith(("n_", "leak_"))]
    return m.agg(F.count(F.lit(1)).alias("documents"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in cols], *[F.round(F.avg((F.col(c) > 0).cast("int")), 6).alias(f"share_{c}") for c in cols if c.startswith("leak")])


@catalog.query(
    "index_parse",
    r"""WITH l AS (SELECT cik, trim(company) AS company, trim(form_type) AS form_type, date_filed, regexp_extract(filename, '([^/]+?)(?:\.txt)?$', 1) AS accession, filename FROM filings
  WHERE cik IS NOT NULL AND company IS NOT NULL AND form_type IS NOT NULL AND date_filed IS NOT NULL AND filename IS NOT NULL AND trim(form_type) IN ('10-K', '10-K/A'))
SELECT cik, company, form_type, date_filed::VARCHAR AS date_filed, accession, filename FROM l QUALIFY row_number() OVER (PARTITION BY accession, cik ORDER BY date_filed, company, form_type, filename) = 1""",
)
def index_parse(spark: SparkSession, d: str) -> DataFrame:
    """The filings written as lines of a published index, header and rulers among them, and read back."""
    fields = ["cik", "company", "form_type", "date_filed", "filename"]
    f = load(pin(spark), d, "filings").dropna(subset=fields)
    lines = f.select(F.concat_ws("|", *fields).alias("value")).unionAll(spark.createDataFrame([("CIK|Company Name|Form Type|Date Filed|Filename",), ("-" * 40,), ("",), ("a note",)], "value string"))
    return parsers.build_index(lines, ["10-K", "10-K/A"]).withColumn("date_filed", F.col("date_filed").cast("string"))


@catalog.query(
    "index_quarters",
    """SELECT y::INT AS year, q::INT AS quarter, 'https://host/edgar/full-index/' || y || '/QTR' || q || '/master.idx' AS url, (make_date(y, q * 3, 1) + INTERVAL 1 MONTH)::DATE <= today AS use_cache
FROM (SELECT max(date_filed) AS today, year(min(date_filed)) AS a, year(max(date_filed)) AS b FROM filings), unnest(range(a, b + 1)) t(y), unnest(range(1, 5)) u(q) WHERE make_date(y, q * 3 - 2, 1) <= today""",
)
def index_quarters(spark: SparkSession, d: str) -> DataFrame:
    """The quarterly indexes to read as of the last day filed: none of the future, and the one in progress afresh."""
    span = load(pin(spark), d, "filings").agg(F.max("date_filed").alias("today"), F.year(F.min("date_filed")).alias("a"), F.year(F.max("date_filed")).alias("b"))
    years = span.select("today", F.explode(F.sequence("a", "b")).alias("year"))
    return parsers.index_quarters(years, base=F.lit("https://host"), today=F.col("today"))


@catalog.query("accession_from_filename", "SELECT filename, accession AS listed, regexp_extract(filename, '([^/]+?)(?:\\.txt)?$', 1) AS derived FROM filings WHERE filename IS NOT NULL")
def accession_from_filename(spark: SparkSession, d: str) -> DataFrame:
    return load(pin(spark), d, "filings").where("filename IS NOT NULL").select("filename", F.col("accession").alias("listed"), parsers.accession(F.col("filename")).alias("derived"))


@catalog.query(
    "public_float",
    """WITH f AS (SELECT cik, period_of_report AS d, date_filed AS filed, cik * 10.0 + year(date_filed) AS val FROM filings
  WHERE cik IS NOT NULL AND period_of_report IS NOT NULL AND date_filed IS NOT NULL AND starts_with(form_type, '10-K'))
SELECT cik, d::VARCHAR AS "end", arg_min(val, filed)::DOUBLE AS value, min(filed)::VARCHAR AS filed FROM f WHERE val BETWEEN 1e6 AND 5e12 GROUP BY cik, d""",
)
def public_float(spark: SparkSession, d: str) -> DataFrame:
    """Facts written as published JSON, a document per company and part of its filings, and read back."""
    f = load(pin(spark), d, "filings").where("cik IS NOT NULL AND period_of_report IS NOT NULL AND date_filed IS NOT NULL")
    val = F.col("cik") * F.lit(10.0) + F.year("date_filed")
    fact = F.struct(F.col("period_of_report").cast("string").alias("end"), val.alias("val"), F.col("date_filed").cast("string").alias("filed"), F.col("form_type").alias("form"))
    part = F.pmod(F.xxhash64("accession"), F.lit(f.count() // 1000 + 1))  # about a thousand facts to a document
    raw = f.groupBy("cik", part.alias("part")).agg(F.to_json(F.struct(F.struct(F.collect_list(fact).alias("USD")).alias("units"))).alias("json"))
    out = parsers.public_float(raw.select("cik", "json"))
    return out.select("cik", F.col("end").cast("string").alias("end"), "value", F.col("filed").cast("string").alias("filed"))


@catalog.query(
    "listed_tickers",
    "SELECT replace(upper(n_name), '-', '.') AS ticker, n_regionkey::BIGINT AS cik, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS rank FROM nation",
)
def listed_tickers(spark: SparkSession, d: str) -> DataFrame:
    """A published file of numbered rows, written from the nations (25 by definition) and read back."""
    row = F.struct(F.col("n_nationkey").cast("string").alias("key"), F.struct(F.col("n_regionkey").alias("cik_str"), F.lower("n_name").alias("ticker"), F.col("n_name").alias("title")).alias("value"))
    raw = load(pin(spark), d, "nation").where("n_nationkey IS NOT NULL").agg(F.to_json(F.map_from_entries(F.collect_list(row))).alias("json"))
    return parsers.listed_tickers(raw).select("ticker", "cik", "rank")


@catalog.query(
    "sector_lists_round_trip", f"WITH {roles.ctes('members')} SELECT snapshot_date::VARCHAR AS snapshot_date, ticker FROM members_r WHERE ticker IS NOT NULL"
)
def sector_lists_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots written as comma lists, each of a bounded part of the tickers, and read back."""
    m = roles.members(spark, d).where("ticker IS NOT NULL")
    parts = m.select("ticker").distinct().count() // 500 + 1
    by = [F.col("snapshot_date").cast("string").alias("date"), F.pmod(F.xxhash64("ticker"), F.lit(parts)).alias("part")]
    wide = m.groupBy(*by).agg(F.concat_ws(", ", F.collect_list("ticker")).alias("tickers")).drop("part")
    return parsers.membership(wide).withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


@catalog.query("wide_to_long", f"WITH {roles.ctes('monthly')} SELECT date::VARCHAR AS date, symbol::VARCHAR AS symbol, round(adj_close, 6) AS adj_close FROM monthly_r")
def wide_to_long(spark: SparkSession, d: str) -> DataFrame:
    """Every price series through the wide form, in blocks of columns: a date has a row per block."""
    slots = 100
    block, slot = F.floor(F.col("symbol") / slots).alias("block"), F.pmod("symbol", F.lit(slots)).alias("slot")
    wide = roles.monthly(spark, d).select("date", block, slot, "adj_close").groupBy("date", "block").pivot("slot", list(range(slots))).agg(F.first("adj_close"))
    long = parsers.wide_prices(wide.withColumn("date", F.struct("date", "block")).drop("block"))
    symbol = (F.col("date.block") * slots + F.col("symbol").cast("bigint")).cast("string")
    return long.select(F.col("date.date").cast("string").alias("date"), symbol.alias("symbol"), F.round("adj_close", 6).alias("adj_close"))


@catalog.query(
    "deterministic_sample", "SELECT accession, cik FROM (SELECT DISTINCT accession, cik FROM filings WHERE accession IS NOT NULL AND cik IS NOT NULL) ORDER BY sha256('42:' || accession || ':' || cik), accession LIMIT 200"
)
def deterministic_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample without replacement: the 200 smallest hashes (the sample is the feature)."""
    f = load(pin(spark), d, "filings").where("accession IS NOT NULL AND cik IS NOT NULL").select("accession", "cik").distinct()
    return f.orderBy(F.sha2(F.concat_ws(":", F.lit("42"), "accession", "cik"), 256), "accession").limit(200)


_FACTOR_SQL = f"{study._RETURNS_SQL}, factors_r AS (SELECT last_day(date) AS month_end, {', '.join(f'avg(ret) FILTER (WHERE symbol % 6 = {k}) AS f{k}' for k in range(6))} FROM returns_r GROUP BY date)"
NAMES = [f"f{k}" for k in range(6)]


def factors(spark: SparkSession, d: str) -> DataFrame:
    """Six monthly series from disjoint groups of symbols, standing in for published factors."""
    r = study.monthly_returns(spark, d)
    return r.groupBy(F.last_day("date").alias("month_end")).agg(*[F.avg(F.when(F.col("symbol") % 6 == k, F.col("ret"))).alias(f"f{k}") for k in range(6)])


@catalog.query(
    "factor_compound",
    f"""WITH {roles.ctes('monthly')}, {_FACTOR_SQL}, quarters_r AS (SELECT month_end FROM factors_r WHERE month(month_end) % 3 = 0)
SELECT e.month_end::VARCHAR AS period_end, round(product(1 + f0) - 1, 6) AS f0, round(product(1 + f1) - 1, 6) AS f1 FROM quarters_r e JOIN factors_r f ON f.month_end > last_day((e.month_end - INTERVAL 3 MONTH)::DATE) AND f.month_end <= e.month_end
GROUP BY e.month_end HAVING count(*) = 3""",
)
def factor_compound(spark: SparkSession, d: str) -> DataFrame:
    """Factors compounded over quarters; a quarter that misses a month drops out."""
    f = factors(spark, d).withColumn("q", F.last_day(F.add_months(F.trunc("month_end", "quarter"), 2)))
    out = f.groupBy("q").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.product(1 + F.col(c)) - 1, 6).alias(c) for c in ("f0", "f1")])
    return out.where("n = 3").select(F.col("q").cast("string").alias("period_end"), "f0", "f1")


def _strategies(spark: SparkSession, d: str) -> DataFrame:
    m = study.monthly(spark, d).withColumn("month_end", F.last_day("date"))
    return m.select("month_end", F.explode(F.create_map(F.lit("gross"), F.col("ret_ls"), F.lit("net"), F.col("ret_ls_net"))).alias("strategy", "ret"))


@catalog.query(
    "factor_ols_1f",
    f"""WITH {roles.ctes('monthly', 'signals', 'members', 'calendar', 'ranges')}, {study._PANEL_SQL}, factors_r AS (SELECT last_day(date) AS month_end, avg(ret) FILTER (WHERE symbol % 6 = 0) AS f0 FROM returns_r GROUP BY date),
{study._legs_sql()}, {study._long_short_sql()}, j AS (SELECT 'gross' AS strategy, ret_ls AS y, f0 FROM monthly_ls JOIN factors_r ON last_day(date) = month_end UNION ALL SELECT 'net', ret_ls_net, f0 FROM monthly_ls JOIN factors_r ON last_day(date) = month_end)
SELECT strategy, count(*) AS months, round(regr_intercept(y, f0), 6) AS alpha, round(regr_slope(y, f0), 6) AS beta, round(regr_r2(y, f0), 6) AS r2 FROM j GROUP BY strategy""",
)
def factor_ols_1f(spark: SparkSession, d: str) -> DataFrame:
    j = _strategies(spark, d).join(factors(spark, d).select("month_end", "f0"), "month_end")
    return j.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("months"), F.round(F.regr_intercept("ret", "f0"), 6).alias("alpha"), F.round(F.regr_slope("ret", "f0"), 6).alias("beta"), F.round(F.regr_r2("ret", "f0"), 6).alias("r2")
    )


_HAC_SQL = """o AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY m) AS i FROM j),
fit AS (SELECT strategy, count(*) AS n, regr_intercept(y, f0) AS a, regr_slope(y, f0) AS b, regr_r2(y, f0) AS r2, sum(f0) AS sx, sum(f0 * f0) AS sxx, floor(4 * pow(count(*) / 100, 2 / 9))::INT AS lags FROM o GROUP BY strategy),
u AS (SELECT o.strategy, i, f0 AS x, y - a - b * f0 AS u, lags FROM o JOIN fit USING (strategy)),
c AS (SELECT p.strategy, CASE WHEN p.i = q.i THEN 1 ELSE 2 * (1 - (p.i - q.i) / (p.lags + 1)) END AS w, p.u * q.u AS uu, p.x AS xp, q.x AS xq FROM u p JOIN u q ON p.strategy = q.strategy AND p.i - q.i BETWEEN 0 AND p.lags),
s AS (SELECT strategy, sum(w * uu) AS s00, sum(w * uu * (xp + xq) / 2) AS s01, sum(w * uu * xp * xq) AS s11 FROM c GROUP BY strategy),
e AS (SELECT *, sxx / (n * sxx - sx * sx) AS i00, -sx / (n * sxx - sx * sx) AS i01, n / (n * sxx - sx * sx) AS i11 FROM fit JOIN s USING (strategy))
SELECT strategy, 'alpha' AS term, round(a, 6) AS coef, round(a / sqrt(i00 * i00 * s00 + 2 * i00 * i01 * s01 + i01 * i01 * s11), 5) AS t, round(r2, 6) AS r2, n::INT AS months, lags FROM e
UNION ALL SELECT strategy, 'f0', round(b, 6), round(b / sqrt(i01 * i01 * s00 + 2 * i01 * i11 * s01 + i11 * i11 * s11), 5), round(r2, 6), n::INT, lags FROM e"""


@catalog.query(
    "factor_hac_1f",
    f"""WITH {roles.ctes('monthly', 'signals', 'members', 'calendar', 'ranges')}, {study._PANEL_SQL}, factors_r AS (SELECT last_day(date) AS month_end, avg(ret) FILTER (WHERE symbol % 6 = 0) AS f0 FROM returns_r GROUP BY date),
{study._legs_sql()}, {study._long_short_sql()}, j AS (SELECT 'gross' AS strategy, month_end AS m, ret_ls AS y, f0 FROM monthly_ls JOIN factors_r ON last_day(date) = month_end UNION ALL SELECT 'net', month_end, ret_ls_net, f0 FROM monthly_ls JOIN factors_r ON last_day(date) = month_end), {_HAC_SQL}""",
)
def factor_hac_1f(spark: SparkSession, d: str) -> DataFrame:
    """One factor with autocorrelation-robust errors, as SQL can say it; factor_ols_hac has all six."""
    out = statistics.factor_regression(_strategies(spark, d), factors(spark, d).select("month_end", "f0"), on="month_end", value="ret", names=["f0"], group="strategy")
    return out.withColumns({"coef": F.round("coef", 6), "t": F.round("t", 5), "r2": F.round("r2", 6)})


@catalog.query("factor_ols_hac")
def factor_ols_hac(spark: SparkSession, d: str) -> DataFrame:
    return statistics.factor_regression(_strategies(spark, d), factors(spark, d), on="month_end", value="ret", names=NAMES, group="strategy")


def variants(spark: SparkSession, d: str) -> DataFrame:
    """Monthly results per variant, repeats removed."""
    b = load(pin(spark), d, "backtest_llm_change_monthly").where("row_id IS NOT NULL AND variant IS NOT NULL")
    keep = ["variant", "period_end", "ret_ls", "ret_ls_net", "ret_long", "ret_short", "ic"]
    return b.groupBy("row_id").agg(*[F.min(c).alias(c) for c in keep])


_VARIANTS_SQL = "variants_r AS (SELECT row_id, min(variant) AS variant, min(period_end) AS period_end, min(ret_ls) AS ret_ls, min(ret_ls_net) AS ret_ls_net FROM backtest_llm_change_monthly WHERE row_id IS NOT NULL AND variant IS NOT NULL GROUP BY row_id)"


@catalog.query(
    "sharpe_moments",
    f"""WITH {_VARIANTS_SQL}, m AS (SELECT variant, count(*) AS n, avg(ret_ls_net) AS mu, stddev_samp(ret_ls_net) AS sd FROM variants_r WHERE ret_ls_net IS NOT NULL GROUP BY variant)
SELECT variant, n, round(mu / sd, 6) AS sharpe, round(avg(pow(ret_ls_net - mu, 3)) / pow(avg(pow(ret_ls_net - mu, 2)), 1.5), 6) AS skew, round(avg(pow(ret_ls_net - mu, 4)) / pow(avg(pow(ret_ls_net - mu, 2)), 2), 6) AS kurt
FROM variants_r JOIN m USING (variant) WHERE ret_ls_net IS NOT NULL GROUP BY variant, n, mu, sd""",
)
def sharpe_moments(spark: SparkSession, d: str) -> DataFrame:
    m = statistics.sharpe_moments(variants(spark, d), ["variant"], "ret_ls_net")
    return m.select("variant", "n", *[F.round(c, 6).alias(c) for c in ("sharpe", "skew", "kurt")])


def _normal_cdf_sql(x: str) -> str:
    """The normal distribution by its series, exact to double precision within six deviations."""
    terms = f"list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)))"
    return f"(0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum({terms}))"


@catalog.query(
    "deflated_sharpe",
    f"""WITH RECURSIVE {_VARIANTS_SQL}, m AS (SELECT variant, count(*) AS n, avg(ret_ls_net) AS mu, stddev_samp(ret_ls_net) AS sd FROM variants_r WHERE ret_ls_net IS NOT NULL GROUP BY variant),
k AS (SELECT variant, n, CASE WHEN sd > 0 THEN mu / sd END AS sharpe, avg(pow(ret_ls_net - mu, 3)) / pow(avg(pow(ret_ls_net - mu, 2)), 1.5) AS skew, avg(pow(ret_ls_net - mu, 4)) / pow(avg(pow(ret_ls_net - mu, 2)), 2) AS kurt
  FROM variants_r JOIN m USING (variant) WHERE ret_ls_net IS NOT NULL GROUP BY variant, n, mu, sd),
p AS (SELECT count(sharpe) AS trials, var_samp(sharpe) AS v, 1 - 1 / count(sharpe) AS p1, 1 - 1 / (count(sharpe) * exp(1)) AS p2 FROM k),
z(z1, z2, i) AS (SELECT 0.0::DOUBLE, 0.0::DOUBLE, 0 UNION ALL SELECT z1 - ({_normal_cdf_sql('z1')} - p1) * sqrt(2 * pi()) * exp(z1 * z1 / 2), z2 - ({_normal_cdf_sql('z2')} - p2) * sqrt(2 * pi()) * exp(z2 * z2 / 2), i + 1 FROM z CROSS JOIN p WHERE i < 60),
t AS (SELECT CASE WHEN trials < 2 THEN 0 ELSE sqrt(v) * ((1 - {statistics.EULER}) * z1 + {statistics.EULER} * z2) END AS threshold FROM p CROSS JOIN (SELECT * FROM z WHERE i = 60))
SELECT variant, n, round(sharpe, 6) AS sharpe, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(threshold, 6) AS threshold,
  round({_normal_cdf_sql('((sharpe - threshold) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe))')}, 6) AS dsr FROM k CROSS JOIN t""",
)
def deflated_sharpe(spark: SparkSession, d: str) -> DataFrame:
    """Deflated by the number of variants tried and the variance of their Sharpe ratios."""
    m = statistics.sharpe_moments(variants(spark, d), ["variant"], "ret_ls_net")
    row = m.agg(F.count("sharpe").alias("n"), F.var_samp("sharpe").alias("v")).first()
    out = statistics.deflated(m, int(row["n"]), float(row["v"] or 0.0))
    return out.withColumns({c: F.round(c, 6) for c in ("sharpe", "skew", "kurt", "threshold", "dsr")})


@catalog.query(
    "trial_sharpes",
    """WITH runs AS (SELECT user_id AS config, ts, event_id, value AS sharpe, props FROM events WHERE value IS NOT NULL),
last AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY config ORDER BY ts DESC, event_id DESC) = 1)
SELECT config, event_id, round(sharpe / sqrt(12 / (coalesce(json_extract(props, '$.k')::BIGINT, 0) % 3 + 1)), 6) AS sharpe_per_period FROM last""",
)
def trial_sharpes(spark: SparkSession, d: str) -> DataFrame:
    """The latest run of each configuration, its ratio taken back to its own period from the settings."""
    log = load(pin(spark), d, "events").where("value IS NOT NULL").select(F.col("user_id").alias("config"), F.col("ts").alias("run_at"), "event_id", "value", "props")
    last = sinks.latest_runs(log, key="config")
    held = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0)) % 3 + 1
    return last.select("config", "event_id", F.round(F.col("value") / F.sqrt(12 / held), 6).alias("sharpe_per_period"))


@catalog.query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the gap between two rank correlations, per variant."""
    gaps = statistics.bootstrap_gap(variants(spark, d), group="variant", a="ret_long", b="ic", y="ret_ls", draws=2000)
    return statistics.interval(gaps, ["variant"], "gap")


@catalog.query(
    "score_agreement",
    f"""WITH s AS (SELECT year(known_at AT TIME ZONE 'UTC')::INT AS date, tone AS score, prev_tone AS ret FROM (SELECT DISTINCT signal_id, known_at, tone, prev_tone FROM signals) WHERE tone IS NOT NULL AND prev_tone IS NOT NULL AND known_at IS NOT NULL),
{study._ic_sql('score', 's')}, m AS (SELECT date, avg(abs(score - ret)) AS shift FROM s GROUP BY date)
SELECT date AS year, n, round(ic, 6) + 0.0 AS spearman, round(shift, 6) AS mean_shift FROM i JOIN m USING (date)""",
)
def score_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Rank agreement and mean shift of a score against the one before it."""
    s = load(pin(spark), d, "signals").select("signal_id", "known_at", "tone", "prev_tone").distinct().where("tone IS NOT NULL AND prev_tone IS NOT NULL AND known_at IS NOT NULL")
    s = s.withColumn("year", F.year("known_at"))
    shift = s.groupBy("year").agg(F.round(F.avg(F.abs(F.col("tone") - F.col("prev_tone"))), 6).alias("mean_shift"))
    return ranking.rank_correlation(s, ["year"], "tone", "prev_tone").join(shift, "year").select("year", "n", (F.round("ic", 6) + 0.0).alias("spearman"), "mean_shift")


@catalog.query(
    "settings_hash",
    """SELECT container, capacity_tokens, substr(sha256('{"capacity_tokens":' || capacity_tokens || ',"container":"' || container || '"}'), 1, 12) AS config_hash FROM containers""",
)
def settings_hash(spark: SparkSession, d: str) -> DataFrame:
    return sinks.settings_hash(load(pin(spark), d, "containers"), ["container", "capacity_tokens"])


@catalog.query(
    "growth_by_variant",
    f"""WITH {_VARIANTS_SQL} SELECT variant, row_id, round(product(1 + ret_ls) OVER (PARTITION BY variant ORDER BY period_end, row_id ROWS UNBOUNDED PRECEDING), 6) AS growth FROM variants_r WHERE ret_ls IS NOT NULL""",
)
def growth_by_variant(spark: SparkSession, d: str) -> DataFrame:
    v = variants(spark, d).where("ret_ls IS NOT NULL").withColumn("at", F.struct("period_end", "row_id"))
    return portfolio.growth(v, "ret_ls", ["variant"], "at").select("variant", "row_id", F.round("growth", 6).alias("growth"))




SCOPE = ("2015-01-01", "2018-12-31")


@catalog.query(
    "scoring_scope",
    f"""WITH {roles.ctes('filings', 'members', 'calendar', 'ranges')}, {lookups.UNIVERSE_SQL}, {lookups.PREV_SQL},
inside AS (SELECT accession FROM universe_r WHERE t IS NOT NULL AND {roles.NY_SQL.format('t')}::DATE BETWEEN DATE '{SCOPE[0]}' AND DATE '{SCOPE[1]}')
SELECT accession FROM inside UNION SELECT prev_accession FROM prev_r WHERE accession IN (FROM inside) AND prev_accession IS NOT NULL""",
)
def scoring_scope(spark: SparkSession, d: str) -> DataFrame:
    """Universe filings accepted within a period of New York days, both included, and their predecessors."""
    day = normal.day_in_zone(F.col("t"))
    inside = lookups.universe(spark, d).where(day.between(*[F.lit(x).cast("date") for x in SCOPE])).select("accession")
    before = lookups.previous_filings(spark, d).join(inside, "accession", "left_semi").where("prev_accession IS NOT NULL")
    return inside.unionByName(before.select(F.col("prev_accession").alias("accession"))).distinct()


CUTOFF = 2018


@catalog.query("memorization_cells")
def memorization_cells(spark: SparkSession, d: str) -> DataFrame:
    """Scores of original and masked excerpts side by side, before and after a cutoff year: rank
    agreement, mean shift, and how the shift differs between the two."""
    s = roles.filings(spark, d).select("accession", "cik", F.year("date_filed").alias("year")).join(sections(spark, d), ["accession", "cik"])
    s = s.withColumn("excerpt", excerpts.excerpt(F.col("text"))["excerpt"]).join(identities(spark, d), "cik", "left")
    s = s.withColumn("key", F.concat_ws("|", "accession", "cik"))
    masked = masking.mask_documents(s, ident="key", text="excerpt", names="names", tickers="tickers").select("key", "masked")
    score = lambda df, text, suffix: excerpts.score_excerpts(df, excerpts.CountingBackend, ident="key", text=text).where("status = 'valid'").select(
        "key", ((F.col("hedging") + F.col("risk_severity") - F.col("tone")) / 3).alias(f"pessimism_{suffix}")
    )
    both = score(s.select("key", "excerpt"), "excerpt", "original").join(score(masked, "masked", "masked"), "key").join(s.select("key", "year"), "key")
    both = both.withColumn("cell", F.when(F.col("year") <= CUTOFF, "pre").otherwise("post"))
    shift = F.col("pessimism_masked") - F.col("pessimism_original")
    out = ranking.rank_correlation(both, ["cell"], "pessimism_original", "pessimism_masked").withColumnRenamed("ic", "spearman")
    gap = both.groupBy("cell").agg(F.avg(shift).alias("mean_shift"), F.avg(F.abs(shift)).alias("mean_abs_shift"))
    means = both.agg((F.avg(F.when(F.col("cell") == "pre", shift)) - F.avg(F.when(F.col("cell") == "post", shift))).alias("difference"))
    return out.join(gap, "cell").join(F.broadcast(means))  # means: one row


@catalog.query(
    "clears_bars",
    f"""WITH {_VARIANTS_SQL}, m AS (SELECT variant, count(*) AS n, avg(ret_ls_net) AS mu, stddev_samp(ret_ls_net) AS sd FROM variants_r GROUP BY variant)
SELECT variant, CASE WHEN mu / (sd / sqrt(n)) > 2 THEN 'clear' WHEN mu > 0 THEN 'weak' ELSE 'none' END AS verdict FROM m""",
)
def clears_bars(spark: SparkSession, d: str) -> DataFrame:
    """A verdict per variant: net return significant, positive, or neither."""
    m = variants(spark, d).groupBy("variant").agg(F.avg("ret_ls_net").alias("mu"), F.stddev_samp("ret_ls_net").alias("sd"), F.count(F.lit(1)).alias("n"))
    t = portfolio.t_stat(F.col("mu"), F.col("sd"), F.col("n"))
    return m.select("variant", F.when(t > 2, "clear").when(F.col("mu") > 0, "weak").otherwise("none").alias("verdict"))
