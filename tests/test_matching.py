import random

from pyspark.sql import functions as F

from foretell.operators import frames, matching
from foretell.plans.domain_queries import questions, venue_matches
from oracle import SF


def greedy(pairs):
    """k ids in order, each the best partner left of its event, ties to the smaller p id."""
    taken, out = set(), []
    for k, e in sorted({(r.k_id, r.event) for r in pairs}):
        best = min(((-r.confidence, r.p_id) for r in pairs if (r.k_id, r.event) == (k, e) and (e, r.p_id) not in taken), default=None)
        if best:
            taken.add((e, best[1]))
            out.append((k, best[1], e, -best[0]))
    return sorted(out)


def test_one_to_one_like_brute_force(spark):
    rng = random.Random(4)
    asked = ["Will Donald Trump win the 2024 presidential election?", "Will the Republican win the 2024 presidential election?", "Will a Democrat win the 2024 presidential election?", "Will Donald J Trump win the 2024 presidential election?", "Will inflation reach 3.5% in 2025?", "Will it rain?"]
    rows = [(i, rng.choice("kp"), rng.choice(["x", "x", "y", None]), rng.choice(asked)) for i in rng.sample(range(1000), 240)]
    f = frames.extract(spark.createDataFrame(rows, "id long, platform string, category string, question string"))
    f = spark.createDataFrame(f.collect(), f.schema)
    k, p = f.filter("platform = 'k'"), f.filter("platform = 'p'")
    expected = greedy(matching.candidates(k, p).collect())
    assert len({e for _, _, e, _ in expected}) > 1 and len({c for _, _, _, c in expected}) > 2
    assert sorted(map(tuple, matching.one_to_one(k, p).collect())) == expected
    lone_k, lone_p = k.filter("question LIKE '%inflation%' AND category = 'x'"), p.filter("question LIKE '%inflation%' AND category = 'x'")
    assert sorted(map(tuple, matching.one_to_one(lone_k, lone_p).collect())) == greedy(matching.candidates(lone_k, lone_p).collect())
    assert matching.one_to_one(k.limit(0), p).count() == 0


def test_venue_matches_reads_every_market(spark):
    got = venue_matches(spark, SF).collect()
    q = questions(spark, SF).withColumn("k", (F.col("platform") == "kalshi").cast("int")).select("market_id", "k", "category", "question").collect()
    sides = {}
    for r in q:
        sides.setdefault((r.question, r.category), ([], []))[r.k].append(r.market_id)
    # each event of these questions has one question, so the n-th markets of a category meet
    together = {(k, p) for ps, ks in sides.values() for k, p in zip(sorted(ks), sorted(ps))}
    assert {(r.k_id, r.p_id) for r in got} <= together
    asked = {r.market_id: r.question for r in q}
    matched = {asked[r.k_id] for r in got}
    assert len(got) == sum(min(len(ps), len(ks)) for (question, _), (ps, ks) in sides.items() if question in matched)
    assert max(r.k_id for r in got) > 600


def test_ids_beyond_doubles_stay_as_they_are(spark):
    big = 2**60
    asked = ["Will Donald Trump win the 2024 presidential election?", "Will the Republican win the 2024 presidential election?", "Will Donald J Trump win the 2024 presidential election?"]
    rows = [(big + 1 + 2 * i, "kp"[i % 2], "x", asked[i % 3]) for i in range(30)]
    f = frames.extract(spark.createDataFrame(rows, "id long, platform string, category string, question string"))
    f = spark.createDataFrame(f.collect(), f.schema)
    k, p = f.filter("platform = 'k'"), f.filter("platform = 'p'")
    expected = greedy(matching.candidates(k, p).collect())
    assert expected and sorted(map(tuple, matching.one_to_one(k, p).collect())) == expected


def test_similar_names_lose_no_pair(spark):
    rng = random.Random(9)
    first, last = ["donald", "john", "joe", "maria", "al", "kamala", "robert", "li"], ["trump", "smith", "smyth", "biden", "de la cruz", "harris", "xi", "o'brien-jones", "jones"]
    names = {f"{rng.choice(first)} {rng.choice(['', 'j ', 'jr '])}{rng.choice(last)}" for _ in range(60)} | {"xi", "li xi", "aaaa", "aaaaaaaa", "ab"}
    for n in list(names):  # spelling mistakes, turned words, parts
        k = rng.randrange(len(n))
        names |= {n[:k] + n[k + 1 :], n[:k] + rng.choice("abc") + n[k:], " ".join(reversed(n.split())), n.split()[-1]}
    names = sorted(n.strip() for n in names if n.strip())
    half = [(n, n.split()[-1]) for n in names if rng.random() < 0.6], [(n, n.split()[-1]) for n in names if rng.random() < 0.6]
    left, right = (spark.createDataFrame(h, f"{c} string, {c}_last string") for h, c in zip(half, "xy"))
    got = {(r.x, r.y): r.names for r in matching.similar_names(left, right).collect()}
    want = {}
    for x, xl in half[0]:
        for y, yl in half[1]:
            score = 100 if x == y else 95 if xl == yl else matching._similarity(x, y)
            if score >= 85:
                want[x, y] = score
    assert len(want) > 200 and got == want
