"""Queries p3, p4, p8, p9 and p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import Catalog
from tidemark.functions import normal
from tidemark.llm import entity_match, mixing, nearest_time, packing, spam, tokens
from tidemark.session import pin, stage
from tidemark.sources.tables import load, load_texts

catalog = Catalog()


@catalog.query(
    "p4_found",
    """
WITH f AS (SELECT cik, acceptance_datetime AS ft, min(accession) AS accession FROM filings
           WHERE acceptance_datetime IS NOT NULL AND cik IS NOT NULL AND accession IS NOT NULL GROUP BY ALL),
s AS (SELECT DISTINCT signal_id, cik, prev_acceptance AS st FROM signals
      WHERE prev_acceptance IS NOT NULL AND cik IS NOT NULL AND signal_id IS NOT NULL),
b AS (SELECT s.*, f.ft AS bt, f.accession AS ba FROM s ASOF LEFT JOIN f ON s.cik = f.cik AND s.st >= f.ft),
a AS (SELECT b.*, f.ft AS at2, f.accession AS aa FROM b ASOF LEFT JOIN f ON b.cik = f.cik AND b.st <= f.ft),
d AS (SELECT *, epoch_us(st) - epoch_us(bt) AS db, epoch_us(at2) - epoch_us(st) AS da FROM a)
SELECT DISTINCT signal_id, CASE WHEN da IS NULL OR db <= da THEN ba ELSE aa END AS accession
FROM d WHERE least(db, da) <= 43200000000""",
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin(spark)
    signals = (load(spark, sf_dir, "signals"), "cik", "prev_acceptance", "signal_id")
    filings = (load(spark, sf_dir, "filings"), "cik", "acceptance_datetime", "accession")
    pairs = nearest_time.nearest_in_time(signals, filings, tolerance_seconds=12 * 3600)
    return pairs.select(F.col("left_id").cast("bigint").alias("signal_id"), F.col("right_id").alias("accession")).distinct()


def companies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The review rows and the vendor's as (id, core, trade, form, state, symbol, tail, y0, y1)."""
    pin(spark)
    name = entity_match.parsed_name
    review = load(spark, sf_dir, "ticker_map_review").withColumn("n", name(F.col("company"))).select(
        F.col("review_id").alias("id"), "n.core", "n.trade", "n.form", "n.state", entity_match.symbol_form(F.col("ticker")).alias("symbol"),
        F.lpad(F.pmod("cik", F.lit(10_000)).cast("string"), 4, "0").alias("tail"), F.year("valid_from").alias("y0"), F.year("valid_to").alias("y1"),
    )
    vendor = load(spark, sf_dir, "vendor_issuers").withColumn("n", name(F.col("issuer_name"))).select(
        F.col("vendor_id").alias("id"), "n.core", "n.trade", "n.form", F.coalesce(F.lower("state"), F.col("n.state")).alias("state"), entity_match.symbol_form(F.col("symbol")).alias("symbol"),
        F.nullif(F.btrim("reg_tail"), F.lit("")).alias("tail"), F.col("first_year").alias("y0"), F.col("last_year").alias("y1"),
    )
    return review, vendor


def company_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(left_id review, right_id vendor, confidence) of all candidate pairs."""
    return entity_match.match_entities(*companies(spark, sf_dir))


_SYMBOL_SQL = r"replace(nullif(regexp_replace(regexp_replace(regexp_replace(upper(trim({}, ' ' || chr(9))), '^[A-Z]+:', ''), '[ /]US$', ''), '[-/ ]+', '.', 'g'), ''), '.', '')"


@catalog.query(
    "p3_blocks_kept",
    f"""WITH r AS (SELECT DISTINCT review_id, {_SYMBOL_SQL.format('ticker')} AS symbol, lpad((cik % 10000)::VARCHAR, 4, '0') AS tail, year(valid_from) AS y FROM ticker_map_review WHERE review_id IS NOT NULL),
v AS (SELECT DISTINCT vendor_id, {_SYMBOL_SQL.format('symbol')} AS symbol, nullif(trim(reg_tail), '') AS tail, first_year AS y FROM vendor_issuers WHERE vendor_id IS NOT NULL),
p AS (SELECT DISTINCT review_id, vendor_id, 'symbol_tail' AS block FROM r JOIN v USING (symbol, tail) UNION SELECT DISTINCT review_id, vendor_id, 'symbol_year' FROM r JOIN v ON r.symbol = v.symbol AND abs(r.y - v.y) <= 2)
SELECT block, count(*) AS pairs, count(*) AS met FROM p GROUP BY block""",
)
def p3_blocks_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that agree on symbol and tail, or on symbol and first year, counted by a plain join of these
    attributes, and those of them that the blocks brought together: all."""
    review, vendor = (stage(df.where("id IS NOT NULL").dropDuplicates(), "companies") for df in companies(spark, sf_dir))
    forms = lambda df, p, *years: df.select(F.col("id").alias(f"{p}_id"), F.regexp_replace("symbol", "\\.", "").alias("symbol"), *years).distinct()
    apart, pair = entity_match.YEARS_APART, lambda df, block: df.select("left_id", "right_id", F.lit(block).alias("block")).distinct()
    near = F.explode(F.sequence(F.col("y0") - apart, F.col("y0") + apart)).alias("y0")
    tails = pair(forms(review, "left", "tail").join(forms(vendor, "right", "tail"), ["symbol", "tail"]), "symbol_tail")
    years = pair(forms(review, "left", near).join(forms(vendor, "right", F.col("y0").cast("int").alias("y0")), ["symbol", "y0"]), "symbol_year")
    agree = tails.unionByName(years)
    # the blocks take each id once, so ids that come in several forms are numbered first
    sides = [df.withColumn("row", F.monotonically_increasing_id()) for df in (review, vendor)]
    one, two = (stage(df, "numbered") for df in sides)
    met = entity_match.candidates(one.drop("id").withColumnRenamed("row", "id"), two.drop("id").withColumnRenamed("row", "id"))
    ids = lambda df, p: df.select(F.col("row").alias(f"{p}_id"), F.col("id").alias(p))
    found = met.join(ids(one, "left"), "left_id").join(ids(two, "right"), "right_id").select(F.col("left").alias("left_id"), F.col("right").alias("right_id"), F.lit(1).alias("met")).distinct()
    return agree.join(found, ["left_id", "right_id"], "left").groupBy("block").agg(F.count(F.lit(1)).alias("pairs"), F.count("met").alias("met"))


@catalog.query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = company_matches(spark, sf_dir).where(F.col("confidence") >= entity_match.MATCH_AT)
    return sure.select(F.col("left_id").alias("review_id"), F.col("right_id").alias("vendor_id"))


@catalog.query("p3_confidence")
def p3_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = company_matches(spark, sf_dir)
    return pairs.select(F.col("left_id").alias("review_id"), F.col("right_id").alias("vendor_id"), F.round("confidence", 6).alias("confidence"))


@catalog.query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_texts(pin(spark), sf_dir, "documents", "doc_id", "text").where("doc_id IS NOT NULL")
    return spam.spam_pages(docs).select("doc_id").distinct()


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, tokens) of all documents, counted once."""
    source = F.translate(normal.label(F.col("source")), "- ", "__")
    docs = load_texts(pin(spark), sf_dir, "documents", "doc_id", "source", "text").select("doc_id", source.alias("source"), tokens.token_count(F.col("text")).alias("tokens"))
    return stage(docs, "sizes")


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sized_documents(spark, sf_dir)
    return packing.pack(sizes.select("doc_id", "tokens"), load(spark, sf_dir, "containers"))


@catalog.query("p8_containers")
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark, sf_dir)


@catalog.query("p8_unused")
def p8_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unused share of every kind of container, by the plain classes and with their left-over room refilled."""
    sizes = sized_documents(spark, sf_dir).select("doc_id", "tokens")
    each = [packing.unused_share(packing.pack(sizes, load(spark, sf_dir, "containers"), refill=refill)).withColumn("refill", F.lit(refill)) for refill in (False, True)]
    return each[0].unionByName(each[1]).withColumns({c: F.round(c, 6) for c in ("unused_share", "refilled_share")})


@catalog.query(
    "p8_invariants",
    """SELECT container, capacity_tokens, (SELECT count(*) FROM documents WHERE length(text) > 0) AS n_items, 0::BIGINT AS tokens_lost, 0::BIGINT AS bins_too_full, 0::BIGINT AS cut_needlessly,
  0::BIGINT AS first_tokens_wrong FROM (SELECT DISTINCT container, capacity_tokens FROM containers WHERE capacity_tokens > 0)""",
)
def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every packing: each text is placed whole and once, no container is too full,
    only a text longer than the capacity is cut, and pieces follow each other without a gap."""
    sizes = sized_documents(spark, sf_dir).select("doc_id", "tokens")
    packed = stage(packing.pack(sizes, load(spark, sf_dir, "containers")), "packed")  # read by bins and by items
    kind = ["container", "capacity_tokens"]
    bins = packed.groupBy(*kind, "bin_id").agg(F.sum("tokens").alias("held")).groupBy(*kind).agg(F.count(F.when(F.col("held") > F.col("capacity_tokens"), 1)).alias("bins_too_full"))
    whole = packing.numbered(sizes.where("tokens > 0")).withColumnRenamed("tokens", "size")
    size = F.sum("tokens").alias("placed")
    pieces = packed.groupBy(*kind, "doc_id", "copy", "bin_id", "part").agg(F.max("tokens").alias("tokens"), F.max("first_token").alias("first_token"))
    parts = pieces.groupBy(*kind, "doc_id", "copy").agg(
        size, F.count(F.when((F.col("part") > 0) & (F.col("first_token") < F.col("capacity_tokens")), 1)).alias("cut"),
        F.count(F.when(F.col("first_token") != F.col("part") * F.col("capacity_tokens"), 1)).alias("wrong"),
    )
    n = whole.groupBy("doc_id", "copy").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    items = parts.alias("p").join(n.alias("n"), F.expr("n.doc_id <=> p.doc_id AND n.copy = p.copy"))
    sums = items.groupBy(*kind).agg(
        F.sum("n").alias("n_items"), F.sum(F.abs(F.col("size") - F.col("placed"))).alias("tokens_lost"), F.sum("cut").alias("cut_needlessly"), F.sum("wrong").alias("first_tokens_wrong")
    )
    return sums.join(bins, kind).select(*kind, "n_items", "tokens_lost", "bins_too_full", "cut_needlessly", "first_tokens_wrong")


def mixed_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = sized_documents(spark, sf_dir)
    targets = load(spark, sf_dir, "mix_targets").withColumn("source", F.translate(normal.label(F.col("source")), "- ", "__"))
    return mixing.mix_sources(sizes, targets)


@catalog.query("p9_selection")
def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(spark, sf_dir)[0]


@catalog.query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = mixed_documents(spark, sf_dir)[1]
    return shares.withColumn("actual_share", F.round("actual_share", 9)).withColumns({c: F.round(c, 3) for c in ("target_tokens", "exact_up_to")})


_SOURCE_SQL = "translate(lower(trim({}, ' ' || chr(9))), '- ', '__')"


@catalog.query(
    "p9_invariants",
    f"""WITH d AS (SELECT {_SOURCE_SQL.format('source')} AS source, count(*) AS n FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND length(text) > 0 GROUP BY 1),
t AS (SELECT DISTINCT mix, {_SOURCE_SQL.format('source')} AS source, target_share, max_repeats FROM mix_targets)
SELECT mix, source, round(target_share, 6) AS target_share, max_repeats, coalesce(n, 0) AS n_docs, 0::BIGINT AS used_too_often, 0::BIGINT AS tokens_misreported, true AS shares_add_up FROM t LEFT JOIN d USING (source)""",
)
def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every mix: no document beyond its cap, and the reported tokens and shares are
    those of the selection."""
    selection, shares = mixed_documents(spark, sf_dir)
    used = selection.groupBy("mix", "source", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.max("repeat_no").alias("last"), F.sum("tokens").alias("tokens"))
    per = used.groupBy("mix", "source").agg(F.max("last").alias("most"), F.sum("tokens").alias("selected"))
    total = shares.groupBy("mix").agg(F.sum("actual_share").alias("sum"))
    out = shares.join(per, ["mix", "source"], "left").join(total, "mix")
    return out.select(
        "mix", "source", F.round("target_share", 6).alias("target_share"), "max_repeats", "n_docs", F.when(F.col("most") > F.col("max_repeats"), 1).otherwise(0).cast("bigint").alias("used_too_often"),
        F.abs(F.coalesce("selected", F.lit(0)) - F.col("tokens")).alias("tokens_misreported"), (F.abs(F.col("sum") - 1) < 1e-9).alias("shares_add_up"),
    )
