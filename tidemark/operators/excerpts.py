"""Excerpts within a word budget, prompts, and strict validation of scored replies."""

from __future__ import annotations

import json
import re
import time
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

# --- fixed values ---------------------------------------------------------------------------
SCORES = ("tone", "hedging", "risk_severity")
FORWARD = r"(?i)\b(?:expect\w*|anticipat\w*|outlook\w*|believ\w*)\b"
PARAGRAPH_WORDS = 8
# --------------------------------------------------------------------------------------------


TokenCounter = Callable[[str], int]


def paragraphs(text: Column) -> Column:
    """Lines of at least eight words, as (line, words)."""
    lines = F.transform(F.split(text, "\n"), lambda p: F.struct(p.alias("p"), F.filter(F.split(p, r"\s+"), lambda w: w != "").alias("w")))
    return F.filter(lines, lambda x: F.size(x["w"]) >= PARAGRAPH_WORDS)


def _fill(kept: Column, budget: int) -> Column:
    """Whole paragraphs while they fit; the first that does not is cut to what is left, and ends it."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        n, left = F.size(x["w"]), budget - acc["used"]
        cut = F.slice(x["w"], F.lit(1), left)
        whole = F.struct(F.array_append(acc["out"], x["p"]).alias("out"), (acc["used"] + n).alias("used"), F.lit(False).alias("done"))
        part = F.struct(F.when(left > 0, F.array_append(acc["out"], F.array_join(cut, " "))).otherwise(acc["out"]).alias("out"), (acc["used"] + left).alias("used"), F.lit(True).alias("done"))
        return F.when(acc["done"], acc).when(n <= left, whole).otherwise(part)

    return F.aggregate(kept, start, step)


def excerpt(text: Column, budget: int = 500, min_forward: int = 200) -> Column:
    """struct<excerpt, method, tokens>, tokens being words: forward-looking paragraphs, or from the
    opening where those fill less than ``min_forward``."""
    all_p = paragraphs(text)
    ahead = _fill(F.filter(all_p, lambda x: x["p"].rlike(FORWARD)), budget)
    opening = _fill(all_p, budget)
    enough = ahead["used"] >= min_forward
    pick = F.when(enough, ahead).otherwise(opening)
    return F.struct(
        F.array_join(pick["out"], "\n\n").alias("excerpt"), F.when(enough, "forward_looking").otherwise("opening_fallback").alias("method"), pick["used"].alias("tokens")
    )


def count_words(text: str) -> int:
    """The default token counter: words between ASCII blanks, as :func:`excerpt` counts them."""
    return len(_words(text))


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]


def pick_excerpt(text: str | None, count: TokenCounter, budget: int = 500, min_forward: int = 200) -> tuple[str, str, int]:
    """(excerpt, method, tokens) under any token counter that never falls as words are added.

    Whole paragraphs as far as their sums stay within the budget, and of the next one the longest
    run of words that still fits.
    """
    lines = [p for p in (text or "").split("\n") if len(_words(p)) >= PARAGRAPH_WORDS]

    def filled(paragraphs: list[str]) -> tuple[str, int]:
        sums = [0, *accumulate(map(count, paragraphs))]
        whole = bisect_right(sums, budget) - 1
        kept, used = paragraphs[:whole], sums[whole]
        if whole < len(paragraphs) and used < budget:
            words = _words(paragraphs[whole])
            n = bisect_right(range(len(words) + 1), budget - used, key=lambda k: count(" ".join(words[:k])) if k else 0) - 1
            part = " ".join(words[:n])
            kept, used = [*kept, part] if n else kept, used + (count(part) if n else 0)
        return "\n\n".join(kept), used

    ahead, used = filled([p for p in lines if re.search(FORWARD, p)])
    return (ahead, "forward_looking", used) if used >= min_forward else (*filled(lines)[:1], "opening_fallback", filled(lines)[1])


def select_excerpts(docs: DataFrame, make_counter: Callable[[], TokenCounter], *, ident: str, text: str, budget: int = 500, min_forward: int = 200) -> DataFrame:
    """(ident, excerpt, method, tokens) with a token counter made once per worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = make_counter()
        for pdf in batches:
            yield pd.DataFrame([(i, *pick_excerpt(t, count, budget, min_forward)) for i, t in zip(pdf[ident].tolist(), pdf[text].tolist())], columns=[ident, "excerpt", "method", "tokens"])

    return docs.select(ident, text).mapInPandas(run, f"{ident} {dict(docs.dtypes)[ident]}, excerpt string, method string, tokens int")


def scores(raw: Column) -> Column:
    """struct<tone, hedging, risk_severity> of a reply, or null: the JSON object from the first to
    the last brace must have exactly these keys, each a number from -1 to 1, no text, no boolean."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    v = F.try_parse_json(body)
    numbers = [F.try_variant_get(v, f"$.{k}", "double") for k in SCORES]
    good = F.array_sort(F.json_object_keys(body)) == F.array(*[F.lit(k) for k in sorted(SCORES)])
    for k, x in zip(SCORES, numbers):
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
        good = good & (kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & x.between(-1.0, 1.0)
    return F.when(good, F.struct(*[x.alias(k) for k, x in zip(SCORES, numbers)]))


def prompt(excerpt_: Column) -> Column:
    """The user message that asks for the three scores of an excerpt."""
    ask = (
        "Rate this excerpt of an annual report. Give a JSON object with exactly the keys tone (-1 negative to 1 positive), "
        "hedging (-1 definite to 1 hedged) and risk_severity (-1 minor to 1 severe), each a number.\n\nExcerpt:\n%s"
    )
    return F.format_string(ask, excerpt_)


class Backend(Protocol):
    """A model that answers prompts; made once per worker."""

    model_id: str

    def generate(self, messages: list[dict]) -> str: ...


class CountingBackend:
    """A deterministic stand-in: scores from word counts, for tests and dry runs."""

    model_id = "counting-1"

    def generate(self, messages: list[dict]) -> str:
        text = messages[0]["content"].rpartition("Excerpt:")[2].lower()
        words = max(len(text.split()), 1)
        rate = lambda *ws: round(max(-1.0, min(1.0, 20 * sum(text.count(w) for w in ws) / words)), 4)
        return json.dumps({"tone": rate("improv", "growth", "recover") - rate("declin", "fell", "weak") / 2, "hedging": rate("may", "could", "might"), "risk_severity": rate("risk", "loss", "shut")})


def valid_reply(raw: str) -> dict | None:
    """The same test as :func:`scores`, for use inside a worker."""
    lo, hi = raw.find("{"), raw.rfind("}")
    try:
        obj = json.loads(raw[lo : hi + 1]) if 0 <= lo < hi else None
    except ValueError:
        return None
    if not isinstance(obj, dict) or set(obj) != set(SCORES):
        return None
    ok = all(isinstance(x, (int, float)) and not isinstance(x, bool) and -1 <= x <= 1 for x in obj.values())
    return {k: float(x) for k, x in obj.items()} if ok else None


def backend_named(name: str, **options: object) -> Backend:
    """A backend by name: ``counting``, or ``replies`` with a function from message to reply."""
    kinds = {"counting": CountingBackend, "replies": RepliesBackend}
    if name not in kinds:
        raise ValueError(f"no backend {name}; there are {', '.join(kinds)}")
    return kinds[name](**options)


class RepliesBackend:
    """Replies from a given function, such as a client of a served model."""

    def __init__(self, reply: Callable[[list[dict]], str], model_id: str = "replies") -> None:
        self._reply, self.model_id = reply, model_id

    def generate(self, messages: list[dict]) -> str:
        return self._reply(messages)


def score_excerpts(work: DataFrame, make_backend: Callable[[], Backend], *, ident: str, text: str, retries: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """(ident, keep..., model, status, tone, hedging, risk_severity, attempts, raw_output, seconds), a row per excerpt.

    A reply that is not valid is asked for again, with a message that says so, ``retries`` times.
    """
    keep = list(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for pdf in batches:
            rows = []
            for *own, message in zip(*[pdf[c].tolist() for c in (ident, *keep, "_message")]):
                talk, began = [{"role": "user", "content": message}], time.monotonic()
                for attempt in range(1, retries + 2):
                    raw = backend.generate(talk)
                    if (found := valid_reply(raw)) is not None:
                        break
                    talk += [{"role": "assistant", "content": raw}, {"role": "user", "content": f"Reply only with a JSON object with the keys {', '.join(SCORES)}, each a number from -1 to 1."}]
                rows.append((*own, backend.model_id, "valid" if found else "invalid", *[(found or {}).get(k) for k in SCORES], attempt, raw, time.monotonic() - began))
            yield pd.DataFrame(rows, columns=[ident, *keep, "model", "status", *SCORES, "attempts", "raw_output", "seconds"])

    kinds = dict(work.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (ident, *keep)) + ", model string, status string, " + ", ".join(f"{k} double" for k in SCORES) + ", attempts int, raw_output string, seconds double"
    return work.select(ident, *keep, prompt(F.coalesce(text, F.lit(""))).alias("_message")).mapInPandas(run, schema)


def run_report(scored: DataFrame, *, in_scope: int, cached: int, cached_valid: int, gate: float) -> DataFrame:
    """One row on a scoring run: what the cache held, what was scored and what is left, valid and invalid, the
    valid share of all in scope, how many needed a second try, excerpts by method, median seconds, and the gate."""
    ok = F.col("status") == "valid"
    out = scored.agg(
        F.count(F.lit(1)).alias("scored"), F.count(F.when(ok, 1)).alias("valid"), F.count(F.when(~ok, 1)).alias("invalid"), F.count(F.when(ok & (F.col("attempts") > 1), 1)).alias("needed_retry"),
        F.count(F.when(F.col("method") == "forward_looking", 1)).alias("forward_looking"), F.count(F.when(F.col("method") == "opening_fallback", 1)).alias("opening_fallback"), F.median("seconds").alias("median_seconds"),
    )
    share = F.round((F.lit(cached_valid) + F.col("valid")) / max(in_scope, 1), 4)
    known = [F.lit(n).cast("bigint").alias(c) for c, n in (("in_scope", in_scope), ("cached", cached))]
    return out.select(*known, *out.columns, (F.lit(in_scope - cached) - F.col("scored")).alias("unscored"), share.alias("valid_share"), (share >= gate).alias("passed"))


def score_cached(work: DataFrame, cache_path: str, make_backend: Callable[[], Backend], *, ident: str, text: str, version: str, model_id: str, retries: int = 1, limit: int | None = None, gate: float = 0.95) -> DataFrame:
    """Score what the cache at ``cache_path`` does not hold under (ident, version, model), write it back, and
    report the run (:func:`run_report`).  ``work`` is (ident, text, method); ``limit`` bounds one run's work.

    The cache is a folder of Parquet files that only grows, so runs that break off lose their own
    rows alone; an id that is there twice counts once.
    """
    spark = work.sparkSession
    schema = f"{ident} {dict(work.dtypes)[ident]}, version string, model string, status string"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    done = (spark.read.schema(schema).parquet(cache_path) if there else spark.createDataFrame([], schema)).where((F.col("version") == version) & (F.col("model") == model_id))
    done = done.groupBy(ident).agg(F.max((F.col("status") == "valid").cast("int")).alias("_ok"))
    held = work.select(ident).join(done, ident).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_ok"), F.lit(0)).alias("ok")).first()
    todo = work.join(done, ident, "left_anti")
    if limit is not None:
        todo = todo.orderBy(ident).limit(limit)
    fresh = stage(score_excerpts(todo, make_backend, ident=ident, text=text, retries=retries, keep=["method"]).withColumn("version", F.lit(version)), "scores")
    fresh.write.mode("append").parquet(cache_path)
    return run_report(fresh, in_scope=work.count(), cached=held["n"], cached_valid=held["ok"], gate=gate)
