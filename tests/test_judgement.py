import math
import random

from pyspark.sql import functions as F

from revlens.operators import judgement as J


def sequential(events, rule):
    """Every judgement in its order, one after the other."""
    rep, nixed, out = {}, set(), []
    get = lambda a: rule.initial if a == 0 else rep.get(a, rule.initial)
    for e in sorted(events, key=lambda e: e["n"]):
        r0, r1, r2 = (get(e[f"author{k}"]) for k in (0, 1, 2))
        q = min(1.0, (e["d02"] - e["d12"]) / e["d01"])
        bad = q < 0 and e["t12"] <= rule.nix_seconds
        if (bad and (rule.weak_nix or (r2 > r1 and r0 > r1))) or (e["n01"] + e["n12"] >= rule.judges and e["t01"] + e["t12"] <= rule.nix_seconds):
            nixed.add(e["revision1"])
        proposed = e["delta"] * q * math.log(1 + max(0.0, r2))
        if rule.capped and not (proposed < 0 or (e["t12"] > rule.nix_seconds and e["revision1"] not in nixed)):
            proposed = max(r1, min(r0, r2, proposed + r1)) - r1
        value = int(max(0.0, min(rule.most, r1 + proposed / rule.scale)) * 100 + 1e-9) / 100
        rep[e["author1"]] = value
        out.append((e["author1"], e["n"], value))
    return sorted(out)


def test_rounds_settle_at_what_one_ordered_pass_gives(spark):
    r = random.Random(3)
    rows = []
    for n in range(70):
        a1 = r.randint(1, 6)
        a2 = r.choice([a for a in range(0, 7) if a != a1])
        rows.append((n, r.randint(0, 6), a1, a2, r.randint(1, 40), r.uniform(10, 900), r.uniform(1, 50), r.uniform(0, 60), r.uniform(0, 60), r.randint(1, 6), r.randint(1, 6), r.uniform(0, 2e5), r.uniform(0, 2e5)))
    names = "n long, author0 long, author1 long, author2 long, revision1 long, delta double, d01 double, d02 double, d12 double, n01 long, n12 long, t01 double, t12 double"
    events = spark.createDataFrame(rows, names).withColumn("dp2", F.lit(1.0)).withColumn("ts", F.timestamp_seconds("n"))
    plain = [dict(zip([c.split()[0] for c in names.split(", ")], x)) for x in rows]
    for rule, block in ((J.Rules(), 10**6), (J.Rules(capped=False, weak_nix=True), 40)):  # of one block and of several
        history = J.reputations(events, "n", rule, block)
        assert sorted((x["author"], x["n"], x["rep"]) for x in history.collect()) == sequential(plain, rule)


def test_judgements_of_a_small_page(spark):
    revs = spark.createDataFrame([("p", n, a, n * 100) for n, a in ((1, 1), (2, 2), (3, 1), (4, 2))], "page string, revision long, author long, s long").withColumn("ts", F.timestamp_seconds("s"))
    d = {(a, b): float(10 * (b - a) + a) for a in range(1, 5) for b in range(a + 1, 5)}
    distances = spark.createDataFrame([("p", a, b, x) for (a, b), x in d.items()], "page string, a long, b long, distance double")
    got = {(r["revision0"], r["revision1"], r["revision2"]): r for r in J.judgements(revs, distances, ["revision"], 3).collect()}
    # judges are of another author than the judged
    assert set(got) == {(1, 2, 3), (1, 3, 4), (2, 3, 4)}
    one = got[1, 3, 4]
    assert (one["d01"], one["d02"], one["d12"], one["delta"], one["dp2"], one["n01"], one["n12"], one["t01"]) == (d[1, 3], d[1, 4], d[3, 4], d[2, 3], d[2, 4], 2, 1, 200.0)
    close = {(r["revision1"], r["revision2"]): r for r in J.closest_judgements(J.judgements(revs, distances, ["revision"], 3), F.lit(2.0)).collect()}
    assert close[3, 4]["closest"] == 2 and close[3, 4]["delta"] == d[2, 3]
    q = max(-1, min(1, (d[2, 4] - d[3, 4]) / d[2, 3]))
    assert math.isclose(close[3, 4]["quality"], q) and math.isclose(close[3, 4]["judge_weight"], 2 * math.exp(-min(d[2, 4], d[3, 4]) / (1 + d[2, 3]) / 3))


def test_values_of_the_golden_statistics(spark):
    """Four revisions: the first and last by one author, two anonymous ones between; published values of distances and words are given."""
    day = [1164194719, 1164215441, 1164223409, 1164234319]
    rows = [(5977, 89371512, 8, "8", day[0], 16, [89371512] * 16), (5977, 89416034, 0, "a", day[1], 2, [89371512] * 16 + [89416034] * 2), (5977, 89428960, 0, "b", day[2], 0, [89371512] * 16 + [89416034] * 2), (5977, 9128857, 8, "8", day[3], 2, [89371512] * 16 + [9128857] * 2)]
    told = spark.createDataFrame(rows, "page long, revision long, author long, name string, s long, n_new long, origin array<long>").withColumn("ts", F.timestamp_seconds("s"))
    a, b, c, d = (r[1] for r in rows)
    given = {(a, b): 2.0, (a, c): 2.0, (b, c): 0.0, (a, d): 2.0, (b, d): 1.0, (c, d): 1.0}
    distances = spark.createDataFrame([(5977, x, y, v) for (x, y), v in given.items()], "page long, a long, b long, distance double")
    judged = J.judgements(told, distances, ["ts"], 10, "name").where("d01 > 0")
    got = {(r["revision0"], r["revision1"], r["revision2"], r["d01"], r["d02"], r["d12"], r["n01"], r["n12"], r["t01"], r["t12"]) for r in judged.collect()}
    assert got == {(a, b, c, 2, 2, 0, 1, 1, 20722, 7968), (a, b, d, 2, 2, 1, 1, 2, 20722, 18878), (a, c, d, 2, 2, 1, 2, 1, 28690, 10910)}
    lives = {(r["revision"], r["n_judges"], r["delta"], r["avg_quality"]) for r in J.edit_lives(judged).collect()}
    assert lives == {(b, 2, 2, 0.75)}
    texts = {(r["revision0"], r["revision1"], r["text"], r["left"], r["n01"], r["t01"]) for r in J.text_judgements(told, ["ts"], 10, "name").collect()}
    assert texts == {(a, b, 16, 16, 1, 20722), (b, c, 2, 2, 1, 7968), (a, c, 16, 16, 2, 28690), (c, d, 0, 0, 1, 10910), (b, d, 2, 0, 2, 18878)}
    lives = {(r["revision"], r["n_judges"], r["new_text"], r["text_life"]) for r in J.text_lives(told, ["ts"], 10, "name").collect()}
    assert lives == {(a, 2, 16, 32), (b, 2, 2, 2), (c, 1, 0, 0), (d, 0, 2, 0)}


def on_line(pages, distance, rule):
    """Every judge in its order, one after the other; pages are lists of (revision, author, seconds, words)."""
    rep, hist, nixed, out = {}, [0.0] * 10, set(), {}
    get = lambda a: rep.get(a, 0.0) if a else 0.0
    clamp = lambda x: max(-1.0, min(1.0, x))
    for t, r2, page, i in sorted((r[2], r[0], p, i) for p, revs in pages.items() for i, r in enumerate(revs)):
        revs = pages[page]
        near = revs[max(0, i + 1 - rule.consider) : i + 1][::-1]
        short = len(near) < rule.consider
        last = len(near) - 1 if short else len(near) - 2
        if last <= 0 or near[0][1] == 999:
            continue
        d = lambda x, y: distance[x[0], y[0]]
        judge = near[0]
        rep2, w = get(judge[1]), math.log(1.2 + get(judge[1]))
        total, left, median = sum(hist), 0.7 * sum(hist), 0.0
        for h in hist if total else ():
            if left <= 0:
                break
            median += left / h if h >= left else 1
            left -= min(h, left)
        weight = max(w, min(w * 10 / median, 10.0)) if median else 10.0
        if judge[1]:
            hist[max(0, min(9, int(w)))] += min(d(x, judge) for x in near[1:])
        scaling = 1 / max(1, min(len(near) - 2, rule.consider // 2))
        for k in range(1, last + 1):
            one = near[k]
            if one[1] == judge[1] or not one[1]:
                continue
            rep1, starts, older = get(one[1]), short and k == last, near[k + 1 :]
            d12 = d(one, judge)
            if starts:
                repc, dc1, dc2, delta = rule.most, one[3], judge[3], one[3]
            else:
                c = min(older, key=lambda x: d(x, judge))
                repc, dc1, dc2, delta = get(c[1]), d(c, one), d(c, judge), min(d(x, one) for x in older)
            if delta <= 0:
                continue
            q = clamp((dc2 - d12) / dc1) if dc1 > 0 else 1.0
            oldest, t12 = near[-1][2], t - one[2]
            if t12 < rule.nix_seconds and (q <= rule.nix_below or (not short and one[2] - oldest < rule.nix_seconds)):
                nixed.add(one[0])
            local = rep1
            if not starts:
                p = near[k + 1]
                ql = clamp((d(p, judge) - d12) / d(p, one)) if d(p, one) > 0 else 1.0
                local = max(rep1, min(rep2, get(p[1]), rep1 + scaling * d(p, one) * ql * weight))
            inc = min(scaling * delta * q * weight, rule.most)
            if inc < 0:
                new = max(0.0, rep1 + inc)
            elif inc > 0 and (one[0] in nixed or t12 < rule.nix_seconds):
                new = max(rep1, local, min(rep2, repc if t - oldest < rule.nix_seconds else rep2, rep1 + inc))
            else:
                new = max(local, rep1 + inc)
            rep[one[1]] = new
            out[one[0], judge[0]] = (one[1], new)
    return out


def on_line_spark(spark, pages, distance, rule, block=10**6):
    rows = [(p, r, a, s, ["w"] * n) for p, revs in pages.items() for r, a, s, n in revs]
    revs = spark.createDataFrame(rows, "page string, revision long, author long, s long, words array<string>").withColumn("ts", F.timestamp_seconds("s"))
    page_of = {r[0]: p for p, v in pages.items() for r in v}
    distances = spark.createDataFrame([(page_of[x], x, y, float(v)) for (x, y), v in distance.items()], "page string, a long, b long, distance double")
    judged = J.on_line_judgements(revs, distances, ["ts", "revision"], spark.createDataFrame([(999,)], "author long"), rule)
    return {(r["revision1"], r["revision2"]): (r["author"], r["rep"]) for r in J.on_line_reputations(judged, rule, block).collect()}


def test_the_start_of_a_page_by_hand(spark):
    day = 86400
    # five words by author 1; two days later author 2 adds two: judged against an empty text, at the greatest weight, as there is no work yet
    pages = {"p": [(1, 1, 0, 5), (2, 2, 2 * day, 7), (3, 3, 2 * day + 60, 8)]}
    distance = {(1, 2): 2.0, (1, 3): 3.0, (2, 3): 1.0}
    got = on_line_spark(spark, pages, distance, J.OnLine())
    assert got[1, 2] == (1, 50.0)
    # author 3 judges both within a minute of author 2: nothing above the judge's own 0 for author 2
    assert got[2, 3] == (2, 0.0) and got[1, 3][1] > 50


def test_on_line_rounds_settle_at_what_one_ordered_pass_gives(spark):
    r = random.Random(11)
    pages, distance, number = {}, {}, 0
    for p in "abc":
        t, revs = r.randint(0, 10**5), []
        for _ in range(12):
            number += 1
            t += r.choice([60, 3600, 50_000, 200_000])
            revs.append((number, r.choice([0, 1, 1, 2, 3, 4, 999]), t, r.randint(3, 40)))
        pages[p] = revs
        for i, x in enumerate(revs):
            for y in revs[i + 1 : i + 8]:
                distance[x[0], y[0]] = float(r.choice([0, 1, 2, 5, 9, 20, 33]))
    for rule, block in ((J.OnLine(), 10**6), (J.OnLine(consider=4), 60)):
        got, want = on_line_spark(spark, pages, distance, rule, block), on_line(pages, distance, rule)
        assert got.keys() == want.keys() and len(got) > 25
        assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], rel_tol=1e-9, abs_tol=1e-9) for k in want)
