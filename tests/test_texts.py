from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import documents, excerpts, masking, wordlists
from tidemark.plans import texts as queries

BODY = " ".join(["Sales grew as orders came in early."] * 60)
OPEN, NEXT, LAST = "ITEM 7 - Discussion of results", "Item 7A: Qualitative disclosures", "ITEM 8. Consolidated financial statements"
CLOSED_BY = "Financial Statements and Supplementary Data"


def page(*lines, tag="div"):
    return "<html><body>" + "".join(f"<{tag}>{x}</{tag}>" for x in lines) + "</body></html>"


def body_of(*lines, **kw):
    return documents.extract(page(*lines), **kw)[0]


def test_only_what_a_reader_sees_stays():
    numbers = "<table><tr><td>" + "8,80 " * 70 + "</td></tr></table>"
    raw = f"""<html><head><title>Never</title></head><body><style>a</style><script>b()</script>
      <p style="color: red; display:none">hidden <b>deep</b></p><div>Seen&nbsp;here</div>{numbers}
      <table><tr><th>Region</th><td>North</td></tr></table><p>- 7 -</p><p>Page 12</p><p>TABLE OF CONTENTS</p><ix:header><p>tags</p></ix:header><p>Done</p></body></html>"""
    assert documents.visible_text(raw) == "Seen here\nRegion North\nDone"
    assert documents.visible_text("Plain   text\r\n\r\n  of two lines ") == "Plain text\nof two lines"


def test_markup_counts_wherever_it_begins():
    late = "<!--" + "x" * 21_000 + "-->" + page(OPEN, BODY, LAST)
    assert documents.extract(late)[0] == BODY


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        ([OPEN, BODY, LAST], BODY),
        ([OPEN, BODY, NEXT, "x", LAST], BODY),
        (["Item 1 Business", OPEN, NEXT, LAST, "Item 1 Business", "We sell.", OPEN, BODY, LAST], BODY),  # a list of contents first
        ([OPEN, "Item 9 Other matters", "y " * 500, OPEN, BODY, LAST], BODY),  # another item cancels
        ([OPEN, BODY, OPEN + ", continued", BODY, LAST], f"{BODY}\n{OPEN}, continued\n{BODY}"),
        (["Item", "7.", "Discussion and outlook", BODY, "Item", "8.", "Financial statements"], f"7.\nDiscussion and outlook\n{BODY}"),
        (["Part II, Item 7 and 7a. Discussion", BODY, LAST], BODY),
        ([OPEN, BODY, "Item 8 of the other report.", "item 3 lists claims", BODY, LAST], f"{BODY}\nItem 8 of the other report.\nitem 3 lists claims\n{BODY}"),
        ([OPEN, BODY, LAST, OPEN, BODY, BODY, LAST], f"{BODY}\n{BODY}"),  # the longest
        ([OPEN, BODY, "z" * 150 + " " + LAST, BODY, LAST], f"{BODY}\n{'z' * 150} {LAST}\n{BODY}"),
    ],
)
def test_the_section_between_item_headings(lines, want):
    assert body_of(*lines) == want and body_of(*lines, max_chars=100) == want


def brute_section(codes):
    """Longest run from the first s after a break to the next e, by trying all pairs."""
    best = None
    for j, c in enumerate(codes):
        if c == "e":
            lo = max((k + 1 for k in range(j) if codes[k] in "eo"), default=0)
            i = next((k for k in range(lo, j) if codes[k] == "s"), None)
            if i is not None and (best is None or j - i > best[1] - best[0]):
                best = (i, j)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_sections_equal_brute_force(seed):
    codes = "".join(random.Random(seed).choices("seo..", k=14))
    text, best = "\n".join(codes), brute_section(codes)
    got = documents.find_section(text, lambda t, at: t[at], 200)
    assert got == (None if best is None else text[2 * best[0] + 1 : 2 * best[1]].strip())


def test_titles_alone_and_reasons_for_failure():
    assert documents.extract(page("Combined Management`s Discussion & Analysis", BODY, CLOSED_BY, tag="p"))[::2] == (BODY, "title_fallback")
    why = lambda *x: documents.extract(page(*x))[1:]
    assert why("Item 2. Properties", BODY) == (0, None, "mda_heading_not_found")
    assert why(OPEN, "See Exhibit 13 of this year.", LAST) == (6, None, "incorporated_by_reference")
    assert why(OPEN, "Nothing to add.", LAST) == (3, None, "section_too_short")
    assert why("Filed under Regulation AB by the depositor.", OPEN, "See Exhibit 13.", LAST)[2] == "abs_issuer_no_mda"
    assert documents.extract("") == documents.extract(None) == documents.extract("\n 12 \n") == (None, 0, None, "empty_document")


def test_extract_sections_table(spark):
    df = spark.createDataFrame([(1, page(OPEN, BODY, LAST)), (2, None), (3, "x" * 300_000), (1, page(OPEN, BODY, LAST))], "i int, html string").withColumn("text", F.lit("other"))
    out = sorted((r["i"], r["status"], r["failure_reason"], r["n_words"]) for r in documents.extract_sections(df, ident="i", html="html").collect())
    assert out == [(1, "ok", None, 420), (1, "ok", None, 420), (2, "failed", "empty_document", 0), (3, "failed", "mda_heading_not_found", 0)]
    assert documents.extract_sections(df.limit(0), ident="i", html="html").collect() == []


def test_excerpt(spark):
    long = " ".join(["word"] * 30)
    ahead = "We expect that the next year will bring far more revenue than this one"
    df = spark.createDataFrame([(1, f"Head\n{long}\n{ahead}\n{ahead} again"), (2, f"Head\n{long}\n{long}"), (3, ""), (4, None)], "i int, t string")
    out = {r["i"]: r["e"] for r in df.select("i", excerpts.excerpt(F.col("t"), 20, 10).alias("e")).collect()}
    assert out[1]["method"] == "forward_looking" and out[1]["tokens"] == 20 and out[1]["excerpt"] == f"{ahead}\n\nWe expect that the next year"[: len(out[1]["excerpt"])]
    assert out[2] == ("word " * 20).strip() or out[2]["excerpt"] == " ".join(["word"] * 20)
    assert out[2]["method"] == "opening_fallback" and out[3]["tokens"] == 0 and out[3]["excerpt"] == ""


@pytest.mark.parametrize(
    ("raw", "ok"),
    [
        ('{"tone": 0.2, "hedging": -0.1, "risk_severity": 0.3}', True), ('x {"tone": 1, "hedging": 0, "risk_severity": -1} y', True), ('{"tone": 0.2, "hedging": -0.1}', False),
        ('{"tone": true, "hedging": 0, "risk_severity": 0}', False), ('{"tone": "0.2", "hedging": 0, "risk_severity": 0}', False), ('{"tone": 1.2, "hedging": 0, "risk_severity": 0}', False),
        ('{"tone": NaN, "hedging": 0, "risk_severity": 0}', False), ('{"tone": 0, "hedging": 0, "risk_severity": 0, "x": 1}', False), ("", False), ('{"tone": 0', False), ("[1]", False), ('{"tone": null, "hedging": 0, "risk_severity": 0}', False),
    ],
)
def test_score_validation(spark, raw, ok):
    row = spark.createDataFrame([(raw,)], "r string").select(excerpts.scores(F.col("r")).alias("s")).first()
    assert (row["s"] is not None) == ok == (excerpts.valid_reply(raw) is not None)


class Stubborn:
    model_id = "stubborn"

    def generate(self, messages):
        return '{"tone": 0, "hedging": 0, "risk_severity": 0}' if len(messages) > 1 else "no"


def test_scoring_retries(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    run = lambda n: {r["i"]: (r["status"], r["attempts"]) for r in excerpts.score_excerpts(df, Stubborn, ident="i", text="t", retries=n).collect()}
    assert run(1) == {1: ("valid", 2), 2: ("valid", 2)} and run(0) == {1: ("invalid", 1), 2: ("invalid", 1)}


def test_word_lists_by_year(spark):
    docs = spark.createDataFrame([(1, "Loss cyberattack closed, plain word."), (2, ""), (3, None)], "i int, t string")
    vocab = spark.createDataFrame([(w,) for w in ("LOSS", "CYBERATTACK", "CLOSED", "PLAIN")], "word string")
    lex = spark.createDataFrame([("LOSS", "negative", "a", 2009), ("CYBERATTACK", "negative", "a", 2014), ("CLOSED", "negative", "r", 2020)], "word string, category string, kind string, year int")
    totals, cohorts = wordlists.cohort_counts(docs, vocab, lex, ident=["i"], text="t")
    years = spark.createDataFrame([(1, y, "negative") for y in (2014, 2015, 2020, 2021)] + [(2, 2015, "negative")], "i int, year_at int, category string")
    out = {(r["i"], r["year_at"]): r["share"] for r in wordlists.shares(totals, cohorts, years, ident=["i"]).collect()}
    assert out == {(1, 2014): 0.5, (1, 2015): 0.75, (1, 2020): 0.75, (1, 2021): 0.5, (2, 2015): None}


BRAND = ["Norvik Paper Mills, Ltd. /ME/", "THE NORVIK GROUP"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Norvik Paper Mills Ltd. grew; norvik paper-mills shrank; the Norvik Group waits.", "[COMPANY] grew; [COMPANY] shrank; [COMPANY] waits."),
        ("Norvik. Norvikian paper and Norvik's mills", "[COMPANY] Norvikian paper and [COMPANY]'s mills"),
        ("NVK, $NVK, NVKX and (NYSE: NVK)", "[TICKER], $NVK, NVKX and (NYSE: [TICKER])"),
        ("In fiscal '19, FY2020 and the 1990s; on Feb. 3, 2011 or 4/5/2012, not 1,999 or 2010.5", "In fiscal [YEAR], FY[YEAR] and the [YEAR]; on [DATE] or [DATE], not 1,999 or 2010.5"),
        ("Norvik Paper & Mills in May 2013", "[COMPANY] in May [YEAR]"),
        ("", ""), ("Nobody is named.", "Nobody is named."),
    ],
)
def test_what_identifies_a_company_is_masked(text, want):
    masked, counts = masking.mask(text, BRAND, ["NVK", "K"])
    assert masked == want and sum(counts.values()) == want.count("[")
    assert masking.leaks(masked, BRAND, ["NVK"])[0] == 0 and (masking.leaks(text, BRAND, ["NVK"])[0] > 0) == ("[COMPANY]" in want)


def test_spellings_of_a_name():
    assert masking.spellings(BRAND[0]) == {("Norvik", "Paper", "Mills", "Ltd."), ("Norvik", "Paper", "Mills"), ("Norvik",)}
    assert masking.spellings("General Glass Co") == {("General", "Glass", "Co"), ("General", "Glass")}
    assert masking.spellings("AT&T Inc.") == {("AT&T", "Inc."), ("AT&T",)} and masking.spellings(" ") == set() and masking.spellings("Inc") == {("Inc",)}
    assert masking.mask("Call AT&T or at&t inc today", ["AT&T Inc."], [])[0] == "Call [COMPANY] or [COMPANY] today"
    assert masking.mask("Smith and Sons; Smith & Sons; Smith Sons", ["Smith & Sons Co"], [])[0] == "[COMPANY]; [COMPANY]; [COMPANY] Sons"


def test_unknown_names_persons_and_places():
    common = frozenset("WE PAID FOR A MILL NEAR THE AND LATER LEFT ADJUSTED GAIN".split())
    text = "We paid Ada Lund for a Zentech mill near Oslo Bay and later Zentech left the SEC. Adjusted Gains in June; NON-GAAP."
    at = lambda x: (text.index(x), text.index(x) + len(x))
    finder = lambda _: [(*at("Ada Lund"), "PERSON"), (*at("Adjusted Gain"), "ORG"), (*at("Oslo Bay"), "GPE"), (*at("SEC"), "ORG")]
    got, counts = masking.mask(text, [], [], finder, common)
    assert got == "We paid [PERSON] for a [NAME] mill near Oslo Bay and later [NAME] left the SEC. Adjusted Gains in June; NON-GAAP."
    assert counts["[NAME]"] == 2 and counts["[PERSON]"] == 1
    assert masking.mask(text, [], [])[0] == text


def test_finders(spark):
    text = "Dr. Ada Lund left Zentech Paper Corp. at Oslo; The SEC asked Lund."
    found = {(text[a:b], kind) for a, b, kind in masking.RuleFinder()(text)}
    assert found == {("Ada Lund", "PERSON"), ("Zentech Paper Corp.", "ORG"), ("Oslo", "GPE")}
    assert masking.mask(text, [], [], masking.RuleFinder())[0] == "Dr. [PERSON] left [ORGANIZATION] at Oslo; The SEC asked Lund."

    class Entity:
        start_char, end_char, label_ = 4, 12, "PERSON"

    model = lambda text: type("Doc", (), {"ents": [Entity]})
    assert masking.model_finder(lambda: model)(text) == [(4, 12, "PERSON")]
    docs = spark.createDataFrame([("the mill ran and the Mill",)] * 5 + [("rare",)], "text string")
    assert queries.common_words(docs, 2) == {"THE", "AND"} and queries.common_words(docs) == {"THE", "AND", "MILL", "RAN"}


@pytest.mark.parametrize("seed", range(20))
def test_marks_settle_by_precedence_length_and_place(seed):
    r = random.Random(seed)
    marks = [(a := r.randrange(40), a + r.randrange(1, 9), r.choice(masking.ORDER)) for _ in range(25)]
    left, want = set(marks), []
    while left:
        best = min(left, key=lambda m: (masking.ORDER.index(m[2]), -(m[1] - m[0]), m[0]))
        want.append(best)
        left = {m for m in left if m[1] <= best[0] or m[0] >= best[1]}
    assert masking.settle(marks, 60) == sorted(want)


def test_masking_table(spark):
    data = [(1, "Norvik in 2020", BRAND, ["NVK"]), (2, None, None, None), (3, "Norvik in 2020", [None, " "], [""]), (1, "Norvik in 2020", BRAND, ["NVK"])]
    df = spark.createDataFrame(data, "i int, t string, n array<string>, k array<string>").withColumn("masked", F.lit(1))
    out = sorted((r["i"], r["masked"], r["leak_name"], r["n_year"]) for r in masking.mask_documents(df, ident="i", text="t", names="n", tickers="k").collect())
    assert out == [(1, "[COMPANY] in [YEAR]", 0, 1)] * 2 + [(2, "", 0, 0), (3, "Norvik in [YEAR]", 0, 1)]


def test_years_and_dates_are_masked_in_every_document(spark, tmp_path):
    texts = ["In fiscal 2014 and FY15 sales fell; by Mar. 3, 2012 all was sold.", "The 1990s, 2005 and 3/4/2011: 1,999 and 2010.5 stay.", "no year here", "fiscal '09 or 12/31/08", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def brute(text):
        for patterns, label in ((masking.DATES, "[DATE]"), (masking.YEARS, "[YEAR]")):
            for p in patterns:
                text = re.sub(p, label, text)
        return hashlib.md5(text.encode()).hexdigest()

    got = dict(map(tuple, queries.date_year_mask(spark, str(tmp_path)).collect()))
    assert got == {i: brute(t) for i, t in enumerate(texts) if t is not None}
    assert got[3] == hashlib.md5(b"fiscal [YEAR] or [DATE]").hexdigest()


def test_extraction_report(spark):
    rows = [(1, "ok", "item_heading", None, 300), (2, "ok", "item_heading", None, 500), (3, "failed", None, "parse_error: x", 0), (4, "failed", None, "parse_error: y", 0), (5, "failed", None, "section_too_short", 20)]
    df = spark.createDataFrame(rows, "doc_id int, status string, method string, failure_reason string, n_words int")
    out = queries.extraction_report(df, 0.9).collect()
    assert {(r["status"], r["failure_reason"]): r["n"] for r in out} == {("ok", None): 2, ("failed", "parse_error"): 2, ("failed", "section_too_short"): 1}
    assert {(r["coverage"], r["median_words_ok"], r["passed"]) for r in out} == {(0.4, 400.0, False)}


def test_excerpts_under_a_token_counter(spark):
    letters = lambda t: len(t)
    text = "Short line\nWe expect that one two three four five six\n" + "word " * 40 + "\nThe outlook is good for all of the eight units here"
    picked, method, used = excerpts.pick_excerpt(text, letters, 60, 10)
    assert method == "forward_looking" and used == len(picked) - 2 <= 60 and picked.split("\n\n")[0] == "We expect that one two three four five six"
    assert text.replace("\n", "\n\n").find(picked.split("\n\n")[1]) > 0 and used + len(" units") > 60 - 8
    assert excerpts.pick_excerpt(None, letters) == ("", "opening_fallback", 0) and excerpts.pick_excerpt("a " * 9, letters, 3, 1)[0] == "a a"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "b " * 700)], "i int, t string")
    native = {r["i"]: tuple(r["e"]) for r in docs.select("i", excerpts.excerpt(F.col("t"), 20, 8).alias("e")).collect() if r["i"] != 2}
    counted = {r["i"]: (r["excerpt"], r["method"], r["tokens"]) for r in excerpts.select_excerpts(docs, lambda: excerpts.count_words, ident="i", text="t", budget=20, min_forward=8).collect() if r["i"] != 2}
    assert native == counted


def test_a_scoring_run_writes_its_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    work = spark.createDataFrame([(i, "We may face risk.", "forward_looking" if i % 2 else "opening_fallback") for i in range(10)], "i int, t string, method string")
    run = lambda **kw: excerpts.score_cached(work, cache, lambda: excerpts.backend_named("counting"), ident="i", text="t", version="v1", model_id="counting-1", **kw).first().asDict()
    first, second, third = run(limit=4), run(), run()
    assert [(x["cached"], x["scored"], x["unscored"]) for x in (first, second, third)] == [(0, 4, 6), (4, 6, 0), (10, 0, 0)] and first["valid_share"] == 0.4 and not first["passed"]
    assert second["valid_share"] == 1.0 and second["passed"] and second["forward_looking"] + first["forward_looking"] == 5 and second["median_seconds"] >= 0
    assert spark.read.parquet(cache).select("i").distinct().count() == 10
    with pytest.raises(ValueError, match="no backend"):
        excerpts.backend_named("none")
    said = excerpts.backend_named("replies", reply=lambda talk: "no")
    assert excerpts.score_excerpts(work, lambda: said, ident="i", text="t").where("status = 'invalid' AND attempts = 2").count() == 10


def test_the_registered_interval_rests_on_2000_draws(spark, tmp_path):
    rows = [(i, "v", i, *(float((i * k) % 31) for k in (7, 11, 13, 17, 19))) for i in range(40)]
    cols = "row_id int, variant string, period_end int, ret_ls double, ret_ls_net double, ret_long double, ret_short double, ic double"
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "backtest_llm_change_monthly.parquet"))
    assert [r["n"] for r in queries.bootstrap_ci(spark, str(tmp_path)).collect()] == [2000]
