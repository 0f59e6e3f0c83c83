from __future__ import annotations

import random

import pytest

from tidemark.llm import spam

PROSE = "The company reported that revenue rose because demand was strong in most regions. We believe that costs may fall when new plants open. Our lenders agreed to extend the facility for two years. "
SPAM = {
    "keywords": "cheap stocks online best cheap stocks free cheap stocks now buy cheap stocks " * 10,
    "links": "\n".join(f"[click here](https://www.picks{i}.example/gold-coins/{i})" for i in range(20)),
    "tags": " ".join(f"#{a}{b}" for a in ("goldcoins", "cheapstocks", "bestbroker") for b in ("", "", "now")) * 3,
    "products": "; ".join(f"SKU {100 + i} MiniSafe {c} 9.{i}" for i, c in enumerate(["red", "blue", "oak", "red"] * 5)),
    "doorway": "\n".join(f"penny stock picks near {t}" for t in ["Lomask", "Calvik", "Ondry", "Brasket"] * 4),
    "hidden": "cheap st​ocks cheap st0cks CHEAP stocks cheap.stocks " * 12,
    "phrases": "Looking for forex robot? Our forex robot page has the best forex robot and gold coins. If you want forex robot then forex robot is the forex robot for you. " * 4,
}
HAM = {
    "prose": PROSE * 3, "prose with list": PROSE * 3 + "\nKey words: free cash flow, free cash flow, capital expenditure\n", "prose with links": PROSE * 3 + SPAM["links"][:200],
    "contents": "Overview ........ 86\nOutlook ........ 117\n" + PROSE * 2, "bullets": "- Goodwill of $5 million was tested in 2012; fair value exceeded book value by 22%\n• The board expects that supply contracts can be renewed\n" * 3,
    "short": "Good morning.", "repeated": "The costs fell after the sale of a plant. " * 12, "german": "Der Umsatz sank trotz schwacher Nachfrage. Die Kosten stiegen wegen höherer Rohstoffpreise. " * 4,
}


@pytest.mark.parametrize("name", SPAM)
def test_spam(name):
    assert spam.is_spam(SPAM[name]) and spam.is_spam(PROSE + "\n" + SPAM[name] * 3)


@pytest.mark.parametrize("name", HAM)
def test_ham(name):
    assert not spam.is_spam(HAM[name])


def brute_repeats(seq):
    n = len(seq)
    out = []
    for i in range(n):
        best = 0
        for k in range(1, i + 2):
            piece = seq[i - k + 1 : i + 1]
            if sum(seq[j : j + k] == piece for j in range(n - k + 1)) >= 2:
                best = k
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_automaton_equals_brute_force(seed):
    r = random.Random(seed)
    seq = "".join(r.choice("abc") for _ in range(r.randrange(0, 45)))
    assert spam.longest_repeats(seq) == brute_repeats(seq)


def test_very_long_and_odd_pages():
    assert spam.page_measures("a " * 100_000)[1] > 0.9 and not spam.is_spam(PROSE * 3000)
    assert spam.page_measures("") == spam.page_measures(None) == spam.page_measures(" \n\t") == (1.0, 0.0)
    assert not spam.is_spam("\x00퟿") and not spam.is_spam("12 34 56")


def test_table(spark):
    data = [(1, SPAM["links"]), (2, HAM["prose"]), (3, None), (4, ""), (1, SPAM["links"]), (None, SPAM["tags"])]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "1 AS clause_share")
    assert sorted(r["doc_id"] or 0 for r in spam.spam_pages(df).collect()) == [0, 1, 1]
    assert spam.spam_pages(df.limit(0)).collect() == []


def test_prose_before_long_links_clears_no_page():
    links = "\n".join(f"https://www.picks.example/gold-coins-and-cheap-stocks-online/page-{i}" for i in range(24))
    page = PROSE * 3 + "\n" + links
    assert spam.is_spam(page) and not spam.is_spam(PROSE * 3 + "\n" + links[:140])


def test_clauses_that_suffice_spare_only_the_repeats():
    for page in [*SPAM.values(), *HAM.values(), *(PROSE + "\n" + x for x in SPAM.values())]:
        clause, repeated = spam.page_measures(page)
        assert spam.is_spam(page) == (clause < spam.MAX_CLAUSE and repeated >= spam.MIN_REPEATED)


@pytest.mark.parametrize(("kinds", "words"), [(60, 200), (100, 300)])
def test_single_keywords_in_varying_order(kinds, words):
    r = random.Random(kinds)
    keys = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(4)) for _ in range(kinds)]
    page = " ".join(r.choice(keys) for _ in range(words))
    assert spam.page_measures(page)[1] > 0.8 and spam.is_spam(page)


OTHER = {
    "ru": ("Выручка компании выросла, потому что спрос был высоким в большинстве регионов. Совет директоров считает, что расходы могут снизиться после запуска новых заводов. Банки согласились продлить кредит ещё на два года. ",
           "дешёвые акции онлайн лучшие дешёвые акции бесплатно дешёвые акции купить сейчас дешёвые акции форекс робот "),
    "pl": ("Przychody spółki wzrosły, ponieważ popyt był silny w większości regionów. Zarząd uważa, że koszty mogą spaść po otwarciu nowych zakładów. Banki zgodziły się przedłużyć kredyt o dwa lata. ",
           "tanie akcje online najlepsze tanie akcje za darmo tanie akcje kup teraz tanie akcje ranking brokerów "),
    "zh": ("公司报告称，由于大多数地区的需求强劲，收入有所增长。我们认为新工厂投产后成本可能会下降。贷款人同意将贷款期限延长两年。",
           "便宜股票在线便宜股票免费便宜股票立即购买便宜股票最佳经纪人外汇机器人便宜股票"),
    "el": ("Τα έσοδα της εταιρείας αυξήθηκαν επειδή η ζήτηση ήταν ισχυρή στις περισσότερες περιοχές. Το συμβούλιο πιστεύει ότι τα έξοδα μπορεί να μειωθούν όταν ανοίξουν τα νέα εργοστάσια. ",
           "φθηνές μετοχές δωρεάν φθηνές μετοχές αγορά τώρα φθηνές μετοχές καλύτερος χρηματιστής "),
}


@pytest.mark.parametrize("lang", OTHER)
def test_any_script(lang):
    prose, stuffing = OTHER[lang]
    assert not spam.is_spam(prose) and not spam.is_spam(prose * 2) and not spam.is_spam(f"{prose}\n\n{prose}")
    assert spam.is_spam(stuffing * 8) and spam.is_spam(prose + "\n" + stuffing * 12) and spam.is_spam("\n".join(stuffing.split() * 6) if lang != "zh" else stuffing * 5)
    assert not spam.is_spam(prose * 3 + "\n" + stuffing)


def test_one_stuffed_line_said_ten_times():
    line = "the best of the cheap stocks and the best of the gold coins for the best of the investors in the market with the best of the forex robots"
    assert spam.page_measures("\n".join([line] * 10)) == (0.0, 1.0) and spam.is_spam("\n".join([line] * 10))


def labelled(r, spammy):
    """A page of known kind from words made up for it, in one of three alphabets."""
    vowels, others = r.choice([("aeiou", "bcdfglmnprstvz"), ("аеиоу", "бвгдклмнпрст"), ("αεηιο", "βγδκλμνπρστ")])
    word = lambda lo, hi: "".join(r.choice(others) + r.choice(vowels) for _ in range(r.randrange(lo, hi)))
    glue, content, keys = [word(1, 2) for _ in range(30)], [word(2, 6) for _ in range(900)], [" ".join(word(2, 5) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(4, 14))]
    sentence = lambda: " ".join(r.choice(glue) if r.random() < 0.35 else r.choice(content) for _ in range(r.randrange(5, 24))).capitalize() + "."
    prose = " ".join(sentence() for _ in range(r.randrange(3, 14)))
    make = r.choice([
        lambda n: r.choice([" ", ", ", "; ", "\n", " - "]).join(r.choice(keys) for _ in range(n)),
        lambda n: "\n".join(f"{r.choice(keys)} https://{word(2, 4)}.example/{r.choice(keys).replace(' ', '-')}/{r.randrange(900)}" for _ in range(n)),
        lambda n: " ".join("#" + r.choice(keys).replace(" ", "") for _ in range(n)),
    ])
    size = len(prose)
    want = r.uniform(2.2, 8) * size if spammy and r.random() < 0.5 else 1500 if spammy else r.uniform(0, 0.5) * size
    block = make(1 + int(want / 22))
    if not spammy:
        return f"{prose}\n{block}" if r.random() < 0.6 else prose
    return block if want == 1500 else f"{prose}\n{block}"


def test_thresholds_come_near_the_best_on_generated_pages():
    """The thresholds, set by hand, against the best of a grid on one half, and on the other half."""
    r = random.Random(21)
    pages = [(spam.page_measures(labelled(r, kind)), kind) for _ in range(300) for kind in (True, False)]
    right = lambda part, c, m: sum((p[0] < c and p[1] >= m) == kind for p, kind in part) / len(part)
    fit, held = pages[:300], pages[300:]
    best = max(right(fit, c / 50, m / 50) for c in range(5, 40) for m in range(2, 30))
    assert right(fit, spam.MAX_CLAUSE, spam.MIN_REPEATED) >= best - 0.01
    assert right(held, spam.MAX_CLAUSE, spam.MIN_REPEATED) >= 0.97
