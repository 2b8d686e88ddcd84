"""Cross-venue matching of frames: blocked by event key, scored by expressions, assigned one to one."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from foretell.functions import text as tx
from foretell.operators.frames import race_key
from foretell.sources.shared import written

LEAST_CONFIDENCE, NAME_THRESHOLD = 0.6, 85
#: Names up to this length share no pair of letters for certain with all that are alike.
SHORT_NAME = 4
#: Sampled ids that cut the id order into buckets for ranks.
BOUNDS = 128


def _indel(a: str, b: str) -> float:
    """100 * 2 * longest common subsequence / total length, in bit-parallel steps."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = s = (1 << len(a)) - 1
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    common = bin(~s & full).count("1")
    return 200.0 * common / (len(a) + len(b))


def _similarity(a: str, b: str) -> int:
    short, long = sorted((a, b), key=len)
    windows = [long[k : k + len(short)] for k in range(len(long) - len(short) + 1)] + [long[:k] for k in range(1, len(short))] + [long[-k:] for k in range(1, len(short))]
    partial = max((_indel(short, w) for w in windows), default=0.0)
    return round(max(_indel(a, b), _indel(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial))


def name_score(a: Column, b: Column) -> Column:
    """0 to 100: equal names 100, equal last names 95, else the best of three edit ratios."""
    x, y = _plain(a), _plain(b)
    sx, sy = tx.name_slug(x), tx.name_slug(y)
    return F.when(x == y, 100).when((sx != "") & (sx == sy), 95).otherwise(_ratio(x, y))


def _plain(name: Column) -> Column:
    return F.trim(F.lower(tx.fold(name)))


def _names(side: DataFrame, frame: str, out: str) -> DataFrame:
    """side with a struct of the plain name and last name of a frame's candidate, worked out once a row and not once a pair."""
    return side.withColumn(out, _plain(F.col(f"{frame}.candidate"))).withColumn(f"{out}_last", tx.name_slug(F.col(out)))


def _ratio(x: Column, y: Column) -> Column:
    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _similarity(p, q) for p, q in zip(x, y)], dtype="Int64")

    return run(x, y)


def _score(rules: list[tuple[Column, float]], most: float, fatal: Column) -> Column:
    total = sum((F.when(F.coalesce(k, F.lit(False)), w).otherwise(0.0) for k, w in rules), F.lit(0.0))
    return F.when(F.coalesce(fatal, F.lit(False)), 0.0).otherwise(F.round(total / most, 3))


def confidence(a: Column, b: Column, names: Column, threshold: int = NAME_THRESHOLD) -> Column:
    """Confidence 0 to 1 that two frames ask the same; contradictions of required fields give 0.  names: name_score of the candidates."""
    same = lambda f: a[f] == b[f]
    differ = lambda f: a[f] != b[f]
    both, one = a.candidate.isNotNull() & b.candidate.isNotNull(), a.candidate.isNotNull() != b.candidate.isNotNull()
    primary = F.coalesce(a.is_primary, F.lit(False)) == F.coalesce(b.is_primary, F.lit(False))
    yes = F.lit(True)
    contest = _score(
        [(yes, 2.0), (same("country"), 1.0), (same("office"), 1.5), (same("year"), 2.0), (same("scope"), 1.0), (one, 0.5), (same("party"), 0.5), (same("outcome_type"), 0.5), (primary, 0.5)], 11.0,
        F.coalesce(differ("year"), F.lit(False)) | F.coalesce(differ("scope"), F.lit(False)) | ~primary | F.coalesce(both & (names < threshold), F.lit(False)),
    )
    contest = F.when((contest > 0) & both, F.round(contest + 2.0 * names / 100 / 11.0, 3)).otherwise(contest)
    gap = F.abs(a.threshold_value - b.threshold_value) / F.greatest(F.abs(a.threshold_value), F.abs(b.threshold_value), F.lit(1.0))
    direction = a.threshold_direction.eqNullSafe(b.threshold_direction)
    level = _score([(yes, 2.0), (same("metric"), 2.0), (same("threshold_value"), 2.0), ((gap > 0) & (gap < 0.05), 1.5), (direction, 1.0), (same("year"), 1.5), (same("actor"), 1.0)], 9.5, F.coalesce(differ("metric"), F.lit(False)) | F.coalesce(gap >= 0.05, F.lit(False)) | F.coalesce(differ("year"), F.lit(False)))
    policy = _score([(yes, 2.0), (same("actor"), 2.0), (same("metric"), 1.5), (direction, 1.0), (same("year"), 1.5)], 8.0, F.coalesce(differ("actor"), F.lit(False)) | F.coalesce(differ("year"), F.lit(False)))
    post = F.coalesce(a.office, a.actor), F.coalesce(b.office, b.actor)
    appointment = _score(
        [(yes, 2.0), (post[0] == post[1], 2.0), (one, 0.5), (same("year"), 1.5), (same("country"), 1.0)], 8.5,
        F.coalesce(post[0] != post[1], F.lit(False)) | F.coalesce(differ("year"), F.lit(False)) | F.coalesce(both & (names < threshold), F.lit(False)),
    )
    appointment = F.when((appointment > 0) & both, F.round(appointment + 2.0 * names / 100 / 8.5, 3)).otherwise(appointment)
    generic = _score([(yes, 2.0), (same("year"), 2.0), (same("actor"), 1.0)], 5.0, F.coalesce(differ("year"), F.lit(False)))
    by = {"contest": contest, "threshold": level, "policy_change": policy, "appointment": appointment}
    return F.when(a.frame_type != b.frame_type, 0.0).otherwise(F.coalesce(*[F.when(a.frame_type == k, v) for k, v in by.items()], generic))


def candidates(kalshi: DataFrame, polymarket: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Scored pairs of one event key: k_id, p_id, event, confidence.  Inputs: id, category, frame; categories that differ do not meet."""
    k = kalshi.select(F.col("id").alias("k_id"), F.col("category").alias("k_cat"), F.col("frame").alias("a"), race_key(F.col("frame")).alias("event"))
    p = polymarket.select(F.col("id").alias("p_id"), F.col("category").alias("p_cat"), F.col("frame").alias("b"), race_key(F.col("frame")).alias("event"))
    return _scored(k, p).filter(F.col("confidence") >= least).select("k_id", "p_id", "event", "confidence")


def similar_names(left: DataFrame, right: DataFrame, least: int = NAME_THRESHOLD) -> DataFrame:
    """x, y, names: every pair of a plain name of left (x) and one of right (y) whose score is at least `least`, once, without comparing all pairs.

    Equal names and equal last names (x_last, y_last) meet by joins.  Of other pairs the shorter name is aligned to the longer or to a window of it no longer than itself; a ratio of r = (least - 0.5) / 100 then leaves at most (1 - r) * 3.5 of its m letters' pairs of neighbours changed (a letter taken out changes two pairs, one put in changes one, and a window may be shorter by some (1 - r) * 2 * m), so of any that many and one more, one stands unchanged in the longer name.  The rarest are taken: they are looked up among all pairs of neighbours of the other side, and only names that meet there are scored.  The same holds for names with sorted words.  Names of at most SHORT_NAME letters are compared with all.
    """
    miss = 1 - (least - 0.5) / 100
    forms = lambda side, c: side.select(c).distinct().select(F.col(c).alias("n"), F.inline(F.array(F.struct(F.lit(0).alias("form"), F.col(c).alias("s")), F.struct(F.lit(1).alias("form"), F.array_join(F.array_sort(F.split(c, "\\s+")), " ").alias("s")))))
    sides = {c: written(forms(side.filter(F.col(c) != ""), c).select("n", "form", F.posexplode(_neighbours("s")).alias("i", "gram"), F.char_length("n").alias("m"))) for side, c in ((left, "x"), (right, "y"))}
    often = sides["x"].select("form", "gram").union(sides["y"].select("form", "gram")).groupBy("form", "gram").agg(F.count("*").alias("often"))

    def meets(short: str, long: str, strict: bool) -> DataFrame:
        rare = Window.partitionBy("n", "form").orderBy("often", "gram", "i")  # the letters of a name
        probes = sides[short].join(often, ["form", "gram"]).withColumn("_r", F.row_number().over(rare)).filter(F.col("_r") <= F.floor(F.col("m") * miss * 3.5) + 1)
        probes = probes.select("form", "gram", F.col("n").alias(short), F.col("m").alias("_m")).distinct()
        held = sides[long].select("form", "gram", F.col("n").alias(long), F.col("m").alias("_l")).distinct()
        fits = F.col("_m") < F.col("_l") if strict else F.col("_m") <= F.col("_l")
        return probes.join(held, ["form", "gram"]).filter(fits).select("x", "y")

    names = {c: side.select(c, f"{c}_last").filter(F.col(c) != "").distinct() for side, c in ((left, "x"), (right, "y"))}
    short = lambda c: F.char_length(c) <= SHORT_NAME
    met = [
        meets("x", "y", False), meets("y", "x", True),
        names["x"].join(names["y"], F.col("x") == F.col("y")).select("x", "y"),
        names["x"].join(names["y"], (F.col("x_last") != "") & (F.col("x_last") == F.col("y_last"))).select("x", "y"),
        names["x"].join(F.broadcast(names["y"].filter(short("y"))), F.lit(True)).select("x", "y"), F.broadcast(names["x"].filter(short("x"))).join(names["y"], F.lit(True)).select("x", "y"),
    ]
    pairs = reduce(DataFrame.union, met).distinct().join(names["x"], "x").join(names["y"], "y")
    same, last = F.col("x") == F.col("y"), (F.col("x_last") != "") & (F.col("x_last") == F.col("y_last"))
    scored = pairs.withColumn("names", F.when(same, 100).when(last, 95).otherwise(_ratio(F.col("x"), F.col("y"))))
    return scored.filter(F.col("names") >= least).select("x", "y", "names")


def _neighbours(c: str) -> Column:
    """The pairs of neighbouring letters of a name, in order."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(2)))


def _scored(k: DataFrame, p: DataFrame) -> DataFrame:
    """Pairs of one event whose categories (k_cat, p_cat) do not differ, with the confidence of frames a and b.  Names are scored once for each pair of different ones; those that are not alike count as 0."""
    k, p = written(_names(k, "a", "_x")), written(_names(p, "b", "_y"))
    pairs = k.join(p, "event").filter(F.coalesce(F.col("k_cat") == F.col("p_cat"), F.lit(True)))
    own = lambda side, c, name: side.filter(F.col(c).isNotNull()).select(F.col(c).alias(name), F.col(f"{c}_last").alias(f"{name}_last"))
    alike = similar_names(own(k, "_x", "x"), own(p, "_y", "y"))
    named = pairs.join(alike, (F.col("_x") == F.col("x")) & (F.col("_y") == F.col("y")), "left")
    named = named.withColumn("names", F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull(), F.coalesce("names", F.when(F.col("_x") == F.col("_y"), 100).otherwise(0))))
    return named.drop("_x", "_y", "_x_last", "_y_last", "x", "y").withColumn("confidence", confidence(F.col("a"), F.col("b"), F.col("names")))


def assign(pairs: DataFrame) -> DataFrame:
    """One to one within an event: in order of k_id, each takes its best partner not yet taken (ties to the smaller p_id)."""

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        taken, rows = set(), []
        for _, own in group.sort_values(["k_id", "confidence", "p_id"], ascending=[True, False, True]).groupby("k_id", sort=False):
            free = own[~own["p_id"].isin(taken)]
            if len(free):
                taken.add(free["p_id"].iloc[0])
                rows.append(free.iloc[0])
        return pd.DataFrame(rows, columns=group.columns)

    return pairs.groupBy("event").applyInPandas(greedy, pairs.schema)


def _classes(side: DataFrame, name: str) -> DataFrame:
    """id, event, class (category and frame), cat and frame of the rows that have an event."""
    event = race_key(F.col("frame"))
    own = side.select(F.col("id").alias(f"{name}_id"), event.alias("event"), F.to_json(F.struct("category", "frame")).alias(f"{name}_class"), F.col("category").alias(f"{name}_cat"), "frame")
    return own.filter(F.col("event").isNotNull())


def _ranked(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """rows with `rank` (from 1) by value within key.  Sampled values cut the order into buckets that number their own rows, so a key may hold any share of the rows."""
    bounds = sorted(r[0] for r in rows.select(value).orderBy(F.xxhash64(value), value).limit(BOUNDS).collect())
    cut = F.lit(0) if not bounds else F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(value)))
    dealt = rows.withColumn("_b", cut)
    local = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "_b").orderBy(value)))
    counts = dealt.groupBy(*key, "_b").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*key).orderBy("_b")) - F.col("_n")).drop("_n")
    return local.join(counts, [*key, "_b"]).withColumn("rank", F.col("_r") + F.col("_before")).drop("_b", "_r", "_before")


def one_to_one(kalshi: DataFrame, polymarket: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """assign(candidates(kalshi, polymarket)) without the pairs of markets, for whole tables.  Inputs as in candidates, an id once a side.

    Markets of an event with equal category and frame form a class, and only classes are paired and scored.  Two classes that have no other partner meet by rank: the n-th k_id takes the n-th p_id.  Classes that contend for partners are walked event by event with their members once each; such an event is one task.
    """
    k, p = written(_classes(kalshi, "k")), written(_classes(polymarket, "p"))
    a = k.groupBy("event", "k_class").agg(F.first("k_cat").alias("k_cat"), F.first("frame").alias("a"))
    b = p.groupBy("event", "p_class").agg(F.first("p_cat").alias("p_cat"), F.first("frame").alias("b"))
    pairs = written(_scored(a, b).filter(F.col("confidence") >= least).select("event", "k_class", "p_class", "confidence"))
    partners = lambda c: F.count("*").over(Window.partitionBy("event", c))
    pairs = pairs.withColumn("_alone", (partners("k_class") == 1) & (partners("p_class") == 1))
    alone, contended = pairs.filter("_alone").drop("_alone"), pairs.filter("NOT _alone").drop("_alone")

    key = ["event", "k_class", "p_class"]
    own_k = _ranked(k.select("k_id", "event", "k_class").join(alone, ["event", "k_class"]), key, "k_id")
    own_p = _ranked(p.select("p_id", "event", "p_class").join(alone.drop("confidence"), ["event", "p_class"]), key, "p_id")
    met = own_k.join(own_p, [*key, "rank"]).select("k_id", "p_id", "event", "confidence")

    kinds = k.schema["k_id"].dataType, p.schema["p_id"].dataType
    text = lambda rows, c: rows.withColumn(c, F.col(c).cast("string"))  # noqa: E731  pandas would make doubles of numbers next to nulls
    of = lambda rows, c: rows.join(contended.select("event", c).distinct(), ["event", c], "left_semi")
    rows = contended.select("event", F.lit(None).cast("string").alias("k_id"), F.lit(None).cast("string").alias("p_id"), "k_class", "p_class", "confidence")
    rows = rows.unionByName(text(of(k, "k_class").select("event", "k_id", "k_class"), "k_id"), allowMissingColumns=True)
    rows = rows.unionByName(text(of(p, "p_class").select("event", "p_id", "p_class"), "p_id"), allowMissingColumns=True)
    order = tuple(int if isinstance(kind, IntegralType) else str for kind in kinds)
    walked = rows.groupBy("event").applyInPandas(lambda group: _walk(group, *order), "k_id string, p_id string, event string, confidence double")
    return met.union(walked.select(F.col("k_id").cast(kinds[0]), F.col("p_id").cast(kinds[1]), "event", "confidence"))


def _walk(group: pd.DataFrame, k_order: type = str, p_order: type = str) -> pd.DataFrame:
    """The greedy assignment of one event from its scored pairs of classes and their members; ids come as text and are ordered as what they are."""
    scored = group[group["confidence"].notna()].sort_values("confidence", ascending=False, kind="stable")
    wanted: dict[str, list[tuple[float, str]]] = {}
    for c, d, sure in zip(scored["k_class"], scored["p_class"], scored["confidence"]):
        wanted.setdefault(c, []).append((sure, d))
    members = lambda i, c, order: sorted((order(x), d) for x, d in group.loc[group[i].notna(), [i, c]].itertuples(index=False))
    free: dict[str, list] = {}
    for i, d in reversed(members("p_id", "p_class", p_order)):
        free.setdefault(d, []).append(i)
    rows = []
    for i, c in members("k_id", "k_class", k_order):
        wanted[c] = left = [(sure, d) for sure, d in wanted[c] if free[d]]
        if left:
            sure, _, d = min(((sure, free[d][-1], d) for sure, d in left if sure == left[0][0]), key=lambda x: x[1])
            rows.append((str(i), str(free[d].pop()), group["event"].iloc[0], sure))
    return pd.DataFrame(rows, columns=["k_id", "p_id", "event", "confidence"])


def validate(matches: DataFrame) -> DataFrame:
    """matches with `warnings`: price gap above 0.25, extraction confidence below 0.5.  Needs k_price, p_price, k_sure, p_sure."""
    k = F.when(F.col("k_price") > 1, F.col("k_price") / 100).otherwise(F.col("k_price"))
    notes = F.array(F.when(F.abs(k - F.col("p_price")) > 0.25, "price gap"), F.when((F.col("k_sure") < 0.5) | (F.col("p_sure") < 0.5), "low confidence"))
    return matches.withColumn("warnings", F.array_compact(notes))


def statistics(matches: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return matches.agg(F.count("*").alias("matches"), F.avg(c).alias("mean_confidence"), F.count_if(c >= 0.9).alias("high"), F.count_if((c >= 0.75) & (c < 0.9)).alias("medium"), F.count_if(c < 0.75).alias("low"))


def keep_best(existing: DataFrame, new: DataFrame, key: str, confidence: str) -> DataFrame:
    """Per key the row with the higher confidence; of equal ones the existing."""
    both = existing.withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0)))
    best = both.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in existing.columns if c != key]), F.struct(confidence, "_old")).alias("x"))
    return best.select(key, "x.*").select(existing.columns)
