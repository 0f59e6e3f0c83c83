"""Matching entities across two tables that share no key.

Candidates share MinHash bands across attributes; every candidate pair gets comparison features; a
logistic classifier is fitted on weak labels and calibrated on held-out ones, and each pair leaves
with a probability.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

# Legal forms, their spellings, and words that carry no identity.
LEGAL = {"incorporated": "inc", "corporation": "corp", "company": "co", "limited": "ltd"}
FORMS = frozenset("inc corp co ltd plc lp trust group holdings llc nv sa ag".split())
NOISE = frozenset({"the", "and"})

PARSED = "core string, trade string, form string, state string"
YEARS_APART, YEAR_WINDOW = 2, 5
MATCH_AT = 0.5
#: (bands, rows a band) of the name's MinHash signature, by what else a band must meet: trade
#: initial and first year, first year alone, trade initial alone, symbol, registration tail.
BANDS = {"trade_year": (40, 3), "year": (12, 6), "trade": (4, 8), "symbol": (8, 1), "tail": (16, 2)}
SIGNATURE = max(b * r for b, r in BANDS.values())
SLICE = 256  # rows of one representative that are spread together


@lru_cache(maxsize=200_000)
def parse_name(name: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    """(core, trade, legal form, state) of a company name; each None where the name has none.

    A name turned round at its comma, as catalogues list them, is turned back unless only legal
    forms follow the comma; accents, case, brackets, blanks and hyphens inside words are dropped, a
    ``/XX/`` tag is the state.  The last of several content words is the trade, the words before
    it, run together, are the core.
    """
    if not name:
        return None, None, None, None
    s = "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c))
    tag = re.search(r"/([a-z]{2,3})/", s)
    s = re.sub(r"/[a-z]{2,3}/", " ", s).strip()
    head, _, rest = s.partition(",")
    rest, _, aside = rest.partition("(")
    if any(w not in FORMS and w not in LEGAL for w in re.findall(r"[a-z0-9]+", re.sub(r"\b([a-z])\.([a-z])\.", r"\1\2", rest))):
        s = f"{rest} {head} {aside}"
    s = re.sub(r"\b([a-z])\.([a-z])\.", r"\1\2", s)
    words = [LEGAL.get(w, w) for w in re.findall(r"[a-z0-9]+", re.sub(r"[-']", "", s)) if w not in NOISE]
    content = [w for w in words if w not in FORMS]
    form = " ".join(w for w in words if w in FORMS)
    core = "".join(content[:-1]) if len(content) > 1 else "".join(content)
    return core or None, content[-1] if len(content) > 1 else None, form or None, tag[1] if tag else None


@lru_cache(maxsize=400_000)
def edits(a: str, b: str) -> int:
    """Optimal string alignment distance: insert, delete, replace, swap of neighbours."""
    if a == b:
        return 0
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


def _alike(a: str, b: str) -> float:
    return 1 - edits(a, b) / max(len(a), len(b), 1)


def _shortened(a: str, b: str) -> bool:
    """One is the other, its beginning, or its letters in order from the first (``retl``, ``dx`` aside)."""
    if len(a) > len(b):
        a, b = b, a
    if a[0] != b[0]:
        return False
    it = iter(b)
    return all(c in it for c in a) or _alike(a, b) >= 0.75


def _base(symbol: str) -> str:
    return symbol.replace(".", "")


GROUPS = {
    "name": ["core_na", "core_far", "core_mid", "core_near", "core_close", "core_same", "core_common", "trade_same", "trade_na", "trade_far", "form_same", "form_na", "form_far", "state_same", "state_far"],
    "symbol": ["symbol_same", "symbol_near", "symbol_na", "symbol_far"],
    "tail": ["tail_same", "tail_mixed", "tail_na", "tail_far"],
    "time": ["y0_0", "y0_1", "y0_2", "y0_far", "y1_0", "y1_1", "y1_2", "y1_far"],
}
FEATURES = [f for g in GROUPS.values() for f in g]
UNKNOWN = {"name": ["core_na", "trade_na", "form_na"], "symbol": ["symbol_na"], "tail": ["tail_na"], "time": []}
VOTES = ["vote_name", "vote_symbol", "vote_tail", "vote_time"]


def compare(a: tuple, b: tuple, seen: int) -> tuple[dict[str, float], tuple[int, int, int, int]]:
    """Features and votes of one pair; ``seen`` counts the rows of either side with the left's core."""
    ac, at, af, as_, asym, atail, a0, a1 = a
    bc, bt, bf, bs, bsym, btail, b0, b1 = b
    f: dict[str, float] = {}
    votes = [0, 0, 0, 0]
    if ac is None or bc is None:
        f["core_na"] = 1
    else:
        s = _alike(ac, bc)
        level = "core_same" if s == 1 else "core_close" if s >= 0.8 else "core_near" if s >= 0.65 else "core_mid" if s >= 0.5 else "core_far"
        f[level] = 1
        if s >= 0.8:
            f["core_common"] = np.log2(max(seen, 1)) / 4
        votes[0] = 1 if s >= 0.8 else -1 if s < 0.5 else 0
    if at is None or bt is None:
        f["trade_na"] = 1
    else:
        same = _shortened(at, bt)
        f["trade_same" if same else "trade_far"] = 1
        if not same:
            votes[0] = -1
    if af is None or bf is None:
        f["form_na"] = 1
    else:
        f["form_same" if af == bf else "form_far"] = 1
    if as_ and bs:
        f["state_same" if as_ == bs.lower() else "state_far"] = 1
    if asym is None or bsym is None:
        f["symbol_na"] = 1
    else:
        x, y = _base(asym), _base(bsym)
        level = "symbol_same" if x == y else "symbol_near" if edits(x, y) <= 1 else "symbol_far"
        f[level] = 1
        votes[1] = {"symbol_same": 1, "symbol_far": -1}.get(level, 0)
    if atail is None or btail is None:
        f["tail_na"] = 1
    else:
        level = "tail_same" if atail == btail else "tail_mixed" if sorted(atail) == sorted(btail) else "tail_far"
        f[level] = 1
        votes[2] = {"tail_same": 1, "tail_far": -1}.get(level, 0)
    near = []
    for side, p, q in (("y0", a0, b0), ("y1", a1, b1)):
        if p is not None and q is not None:
            d = int(abs(p - q))  # a batch with gaps comes as floats
            f[f"{side}_{d}" if d <= 2 else f"{side}_far"] = 1
            near.append(d)
    if near:
        votes[3] = 1 if len(near) == 2 and max(near) <= 1 else -1 if max(near) > 3 else 0
    return f, tuple(votes)


def _featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    null = lambda v: None if v is None or v != v or v is pd.NA else v
    for pdf in batches:
        rows = np.zeros((len(pdf), len(FEATURES)), dtype=np.float32)
        votes = np.zeros((len(pdf), 4), dtype=np.int8)
        at = {f: i for i, f in enumerate(FEATURES)}
        for n, (a, b, seen) in enumerate(_sides(pdf)):
            f, v = compare(tuple(null(x) for x in a), tuple(null(x) for x in b), seen)
            for k, x in f.items():
                rows[n, at[k]] = x
            votes[n] = v
        out = pd.DataFrame(rows, columns=FEATURES)
        out[VOTES] = votes
        out.insert(0, "draw", pdf["draw"].to_numpy())
        out.insert(0, "right_id", pdf["right_id"].to_numpy())
        out.insert(0, "left_id", pdf["left_id"].to_numpy())
        yield out


_SIDE = ["core", "trade", "form", "state", "symbol", "tail", "y0", "y1"]


def _sides(pdf: pd.DataFrame) -> Iterator[tuple]:
    left = zip(*[pdf[f"l_{c}"].to_list() for c in _SIDE])
    right = zip(*[pdf[f"r_{c}"].to_list() for c in _SIDE])
    return zip(left, right, pdf["seen"].to_list())


def parsed_name(col: Column) -> Column:
    """struct<core, trade, form, state> of a name column."""

    @F.pandas_udf(PARSED)
    def parse(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_name(n) for n in names], columns=["core", "trade", "form", "state"])

    return parse(col)


def symbol_form(col: Column) -> Column:
    """``XNX:abc1``, ``ABC1 US``, ``ABC1/A`` and ``ABC1-A`` brought to ``ABC1`` and ``ABC1.A``."""
    s = F.upper(F.btrim(col, F.lit(" \t")))
    s = F.regexp_replace(F.regexp_replace(s, "^[A-Z]+:", ""), "[ /]US$", "")
    return F.nullif(F.regexp_replace(s, "[-/ ]+", "."), F.lit(""))


def _mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def band_keys(cores: list[str]) -> np.ndarray:
    """A row of band keys for each name: MinHash over the padded three-letter shingles, all names at once.

    The kinds of :data:`BANDS` follow each other and read the same signature from its start.
    """
    letters = [np.frombuffer(f"^{c}$".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) for c in cores]
    grams = [(x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:] for x in letters]
    starts = np.cumsum([0, *map(len, grams)])[:-1]
    flat = np.concatenate(grams)
    least = [np.minimum.reduceat(_mixed(flat + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k + 1)), starts) for k in range(SIGNATURE)]
    keys = []
    for n, rows in BANDS.values():
        for b in range(n):
            key = np.full(len(cores), b + 1, dtype=np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                key = _mixed(key * np.uint64(31) + least[k])
            keys.append(key)
    return np.column_stack(keys).view(np.int64)


def signature_bands(core: Column) -> Column:
    """array<bigint> of :func:`band_keys`, null for a null or empty name."""

    @F.pandas_udf("array<bigint>")
    def keys(cores: pd.Series) -> pd.Series:
        codes, names = pd.factorize(cores.where(cores != "", None))
        if not len(names):
            return pd.Series([None] * len(cores))
        with np.errstate(over="ignore"):
            bands = list(band_keys(list(names)))
        return pd.Series([bands[c] if c >= 0 else None for c in codes])

    return keys(core)


def _block_keys(side: DataFrame, spread: int) -> DataFrame:
    """(id, y0, block) keys; ``spread`` widens this side's first year by so many years each way.

    Years meet in windows, so a row has one or two of them whatever the spread.
    """
    windows = F.sequence(*[F.floor((F.col("y0") + by) / F.lit(YEAR_WINDOW)) for by in (-spread, spread)])
    years = F.coalesce(windows, F.array().cast("array<bigint>"))
    side = side.select(
        "id", "y0", "tail", F.regexp_replace("symbol", "\\.", "").alias("sym"), years.alias("years"), F.substring("trade", 1, 1).alias("initial"), signature_bands(F.col("core")).alias("bands")
    )
    at, of = 1, {}
    for kind, (n, _) in BANDS.items():
        of[kind] = F.coalesce(F.slice("bands", at, n), F.array().cast("array<bigint>"))
        at += n
    each = lambda kind, *more: F.transform(of[kind], lambda b: F.xxhash64(F.lit(kind), b, *more))
    yearly = lambda key: F.flatten(F.transform("years", key))
    known = lambda *c: F.array_contains(F.array(*[F.col(x).isNull() for x in c]), False) & ~F.array_contains(F.array(*[F.col(x).isNull() for x in c]), True)
    keys = [
        F.when(known("sym", "tail"), F.array(F.xxhash64(F.lit("st"), "sym", "tail"))),
        F.when(known("sym"), F.transform("years", lambda y: F.xxhash64(F.lit("sy"), "sym", y))),
        F.when(known("sym"), each("symbol", F.col("sym"))),
        F.when(known("tail"), each("tail", F.col("tail"))),
        F.when(known("initial"), each("trade", F.col("initial"))),
        F.when(known("initial"), yearly(lambda y: each("trade_year", y, F.col("initial")))),
        yearly(lambda y: each("year", y)),
    ]
    none = F.array().cast("array<bigint>")
    timed = [False, True, False, False, False, True, True]
    of_kind = lambda want: F.array_distinct(F.flatten(F.array(*[F.coalesce(k, none) for k, t in zip(keys, timed) if t == want])))
    both = F.array(F.struct(F.lit(None).cast("int").alias("y0"), of_kind(False).alias("blocks")), F.struct(F.col("y0").cast("int").alias("y0"), of_kind(True).alias("blocks")))
    return side.select("id", F.inline(both)).select("id", "y0", F.explode("blocks").alias("block"))


def _collapsed(side: DataFrame, columns: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
    """Representatives (rep, slices, columns...) of the equal rows of a side, and their rows as (rep, slice, id)."""
    groups = side.groupBy(*columns).agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    reps = stage(groups.withColumn("rep", F.monotonically_increasing_id()), tag)  # written once, so the numbers stay
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]
    members = side.alias("s").join(reps.alias("r"), same).select("r.rep", F.pmod(F.xxhash64("s.id"), "r.slices").cast("int").alias("slice"), "s.id")
    return reps, stage(members, "members")


def _spread(pairs: DataFrame, key: str, reps: DataFrame, members: DataFrame, ident: str) -> DataFrame:
    """Each pair once for every row behind the representative ``key``, a crowded one's rows in slices."""
    slices = reps.select(F.col("rep").alias(key), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    rows = members.select(F.col("rep").alias(key), "slice", F.col("id").alias(ident))
    return pairs.join(slices, key).join(rows, [key, "slice"]).drop(key, "slice")


def _crowds(a: DataFrame, b: DataFrame) -> DataFrame:
    """(block, na, nb) of the blocks met by both sides."""
    count = lambda k, n: k.groupBy("block").agg(F.count(F.lit(1)).alias(n))
    return count(a, "na").join(count(b, "nb"), "block")


def _met(a: DataFrame, b: DataFrame, salted: int) -> DataFrame:
    """Distinct (left, right) of keys (id, block); blocks of more than ``salted`` pairs are cut by
    the left id into parts that each meet the whole right side."""
    parts = F.least(F.ceil(F.col("na") * F.col("nb") / salted), F.col("na")).cast("int")
    large = stage(_crowds(a, b).where(F.col("na") * F.col("nb") > salted).select("block", parts.alias("parts")), "crowded")
    a, b, on = a.withColumnsRenamed({"id": "left", "y0": "ly"}), b.withColumnsRenamed({"id": "right", "y0": "ry"}), ["block"]
    if not large.isEmpty():
        n = F.coalesce("parts", F.lit(1))
        a = a.join(large, "block", "left").withColumn("part", F.pmod(F.xxhash64("left"), n).cast("int")).drop("parts")
        b = b.join(large, "block", "left").withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).drop("parts")
        on = ["block", "part"]
    near = F.col("ly").isNull() | F.col("ry").isNull() | (F.abs(F.col("ly") - F.col("ry")) <= YEARS_APART)
    return a.join(b, on).where(near).select("left", "right").distinct()


def candidates(left: DataFrame, right: DataFrame, *, salted: int = 1_000_000) -> DataFrame:
    """Distinct (left_id, right_id) that agree on a band or value of two attributes at once; each id comes once.

    A block joins two attributes or three: a MinHash band of the name with symbol, with tail, with
    the trade's initial, with the first year or with both of these; symbol with tail; symbol with
    first year (years up to two apart).  The less the other attributes tell, the more rows of the
    signature a band holds, so that names meet by chance about as seldom in every kind of block.
    A single frequent name, symbol or year never makes a block by itself.

    Rows alike in all that blocks read meet as one representative and are spread again, so a
    company that holds a third of all rows costs its distinct forms, not its rows; blocks still
    large are salted.  No pair is lost by either, and no block is cut.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = ["core", "trade", "symbol", "tail", "y0"]
    sides = []
    for side, spread in ((left, YEARS_APART), (right, 0)):
        short = side.withColumns({"trade": F.substring("trade", 1, 1), "symbol": F.regexp_replace("symbol", "\\.", "")}).select("id", *read)
        reps, members = _collapsed(short, read, "profiles")
        keys = stage(_block_keys(reps.withColumnRenamed("rep", "id").repartition(parts, "id"), spread), "blocks")  # read by counts and join
        sides.append((reps, members, keys))
    (one, ones, a), (two, twos, b) = sides
    return _spread(_spread(_met(a, b, salted), "left", one, ones, "left_id"), "right", two, twos, "right_id")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (intercept last) of an L2-penalised logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    keep = np.full(x.shape[1], penalty)
    keep[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ beta)
        grad = x.T @ (w * (p - y)) + keep * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9)
        move = np.linalg.solve(hess, grad)
        beta -= move
        if np.abs(move).max() < 1e-7:
            break
    return beta


def masked(x: np.ndarray, group: str) -> np.ndarray:
    """The same pairs as if this group of attributes were missing."""
    out = x.copy()
    for f in GROUPS[group]:
        out[:, FEATURES.index(f)] = 1.0 if f in UNKNOWN[group] else 0.0
    return out


def train(x: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, tuple[float, float]]:
    """Classifier weights and the slope and shift that calibrate its logits on the pairs ``held`` out.

    Weak labels come from agreement of several attribute groups; each labelled pair is also shown
    with single groups masked, so the weight of every group is learnt where another is missing.
    """
    if held.all() or not held.any() or len(set(y[~held])) < 2:
        held = np.zeros(len(y), dtype=bool)

    def views(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        xs = [x[at], *[masked(x[at], g) for g in GROUPS]]
        return np.vstack(xs), np.tile(y[at], len(xs)), np.tile(w[at], len(xs)) * np.repeat([1.0] + [0.25] * len(GROUPS), at.sum())

    beta = fit_logistic(*views(~held))
    if not held.any():
        return beta, (1.0, 0.0)
    vx, vy, vw = views(held)
    logit = np.column_stack([vx, np.ones(len(vx))]) @ beta
    slope, shift = fit_logistic(logit[:, None], vy, vw, penalty=0.1)
    return beta, (float(slope), float(shift))


def match_entities(left: DataFrame, right: DataFrame, *, sample: int = 40_000) -> DataFrame:
    """(left_id, right_id, confidence) of all candidate pairs of two tables.

    Both sides come as (id, core, trade, form, state, symbol, tail, y0, y1), any attribute null.
    Equal rows of a side are matched as one representative, and every pair is spread to the rows
    behind it.  The classifier is fitted on the driver on about ``sample`` weakly labelled pairs of each
    class, drawn by a hash of their attributes and weighted back; a fifth of them, by the same
    hash, is held out to calibrate.  Candidates, features and scores cover all rows, every
    candidate is scored, and confidences depend on the rows alone, not on how they are spread.
    A pair is labelled a match where at least two of the groups name, symbol, tail and time speak
    for it net of those against it, a non-match where, time aside, more speak against it than for
    it.  Without labels of both classes no pair is returned, as nothing can be learnt.  Rows with a null id are ignored;
    repeated ids give repeated rows no new pairs.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = {"left_id": dict(left.dtypes)["id"], "right_id": dict(right.dtypes)["id"]}
    left = stage(left.where("id IS NOT NULL").dropDuplicates(["id", *_SIDE]), "left")
    right = stage(right.where("id IS NOT NULL").dropDuplicates(["id", *_SIDE]), "right")
    seen = left.select("core").unionAll(right.select("core")).where("core IS NOT NULL").groupBy("core").agg(F.count(F.lit(1)).alias("seen"))
    (one, ones), (two, twos) = _collapsed(left, _SIDE, "representatives"), _collapsed(right, _SIDE, "representatives")
    print_of = F.xxhash64(*_SIDE)
    named = lambda df, p: df.select(F.col("rep").alias("left_id" if p == "l" else "right_id"), print_of.alias(f"{p}_print"), *[F.col(c).alias(f"{p}_{c}") for c in _SIDE])
    pairs = candidates(one.withColumnRenamed("rep", "id"), two.withColumnRenamed("rep", "id"))
    known = named(one, "l").join(seen.withColumnRenamed("core", "l_core"), "l_core", "left").withColumn("seen", F.coalesce("seen", F.lit(1)))
    wide = (
        pairs.join(known, "left_id").join(named(two, "r"), "right_id")
        .withColumn("draw", F.shiftrightunsigned(F.xxhash64("l_print", "r_print"), 1))
        .repartition(parts * 4, "left_id", "right_id")  # comparing costs far more than bytes tell
    )
    schema = "left_id bigint, right_id bigint, draw bigint" + "".join(f", {f} float" for f in FEATURES) + "".join(f", {v} tinyint" for v in VOTES)
    scored = stage(wide.mapInPandas(_featurise, schema), "pairs")
    ident = sum((F.col(v).cast("int") for v in VOTES if v != "vote_time"), F.lit(0))
    label = F.when(ident + F.col("vote_time") >= 2, 1).when(ident <= -1, 0)
    labelled = scored.withColumn("label", label).where("label IS NOT NULL")
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return scored.select(*[F.col(c).cast(t).alias(c) for c, t in ids.items()], F.lit(None).cast("double").alias("confidence")).limit(0)
    drawn = []
    for label, n in sorted(sizes.items()):
        rows = labelled.where(F.col("label") == label)
        if n > sample:
            rows = rows.where(F.col("draw") < (1 << 63) * sample // n)
        part = rows.select("draw", *FEATURES).toPandas().sort_values(["draw", *FEATURES])
        held = part["draw"].to_numpy(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        drawn.append((part[FEATURES].to_numpy(dtype=float), np.full(len(part), float(label)), np.full(len(part), n / max(len(part), 1)), held % np.uint64(5) == 0))
    beta, (slope, shift) = train(*[np.concatenate(p) for p in zip(*drawn)])
    logit = sum((F.col(f).cast("double") * float(b) for f, b in zip(FEATURES, beta)), F.lit(float(beta[-1])))
    judged = scored.select(F.col("left_id").alias("left"), F.col("right_id").alias("right"), (1 / (1 + F.exp(-(logit * slope + shift)))).alias("confidence"))
    return _spread(_spread(judged, "left", one, ones, "left_id"), "right", two, twos, "right_id").select("left_id", "right_id", "confidence")
