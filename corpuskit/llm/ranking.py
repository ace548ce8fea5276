"""Problem 7: one ranking from paired comparisons with draws and an order effect.

An answer on the pair (i first, j second) is first, second or draw with chances in
proportion to exp(t_i + d), exp(t_j) and exp(v + (t_i + d + t_j) / 2): strengths t, first
position d, draws v. The penalised likelihood is concave; it is fitted by Newton's method
on the counts of outcomes per ordered pair, so the answers themselves are read once. Small
dimensions are solved on the driver; for any larger one the same steps are taken by
conjugate gradients over joins.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.llm.votes import latest_answers
from corpuskit.operators.lineage import cut, read_table, stored

#: Items of one dimension up to which the driver solves the dense Newton system.
DENSE_ITEMS = 2_000
#: Ordered pairs of one dimension up to which the driver holds their counts.
DENSE_PAIRS = 500_000
#: Items whose errors are solved for together beyond these sizes.
BLOCK = 64
#: Weight of the squared strengths, and of the squared effects of order and draws.
PENALTY, PENALTY_ORDER = 0.5, 1e-3


def outcome_counts(preferences: DataFrame, comparisons: DataFrame) -> DataFrame:
    """(dimension, first, second, wins, losses, draws) over the answers that hold.

    tie and both_bad are draws. Comparisons are taken once however often repeated (of
    rows that differ, the least pair); those without a method, or of a method with itself,
    are left out. Answers are counted per comparison before the join.
    """
    votes = (
        latest_answers(preferences)
        .groupBy("comparisonId", "dimension")
        .agg(F.count(F.when(F.col("k") == 0, 1)).alias("wins"), F.count(F.when(F.col("k") == 1, 1)).alias("losses"), F.count(F.when(F.col("k") >= 2, 1)).alias("draws"))
    )
    pairs = (
        comparisons.filter("comparisonId is not null and leftMethod is not null and rightMethod is not null and leftMethod <> rightMethod")
        .groupBy("comparisonId")
        .agg(F.min(F.struct("leftMethod", "rightMethod")).alias("p"))
        .select("comparisonId", F.col("p.leftMethod").alias("first"), F.col("p.rightMethod").alias("second"))
    )
    return votes.join(pairs, "comparisonId").groupBy("dimension", "first", "second").agg(*[F.sum(c).alias(c) for c in ("wins", "losses", "draws")])


# What each outcome (first, second, draw) takes of the strengths of both sides, of the first
# position and of draws.
_TAKES = np.array([[1.0, 0.0, 1.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.5, 0.5, 0.5, 1.0]])


def newton(first, second, counts, n_items, penalty=PENALTY, rounds=100, tolerance=1e-10):
    """Strengths (mean 0), their standard errors, first-position and draw parameter.

    Gradient and Hessian are added up pair by pair, so that the memory is that of the pairs
    and of one square matrix over the items."""
    size = n_items + 2
    places = np.stack([first, second, np.full(len(first), n_items), np.full(len(first), n_items + 1)])
    ridge = np.full(size, penalty)
    ridge[n_items:] = PENALTY_ORDER
    total = counts.sum(axis=1)
    theta = np.zeros(size)

    def chances(t):
        z = _TAKES @ t[places]
        top = z.max(axis=0)
        p = np.exp(z - top)
        s = p.sum(axis=0)
        return p / s, (counts.T * z).sum() - (total * (top + np.log(s))).sum() - 0.5 * (ridge * t * t).sum()

    p, now = chances(theta)
    for _ in range(rounds):
        left = _TAKES.T @ (counts.T - total * p)
        gradient = sum(np.bincount(places[a], left[a], size) for a in range(4)) - ridge * theta
        mean = _TAKES.T @ p
        hessian = np.zeros(size * size)
        for a in range(4):
            for b in range(4):
                own = total * ((_TAKES[:, a] * _TAKES[:, b]) @ p - mean[a] * mean[b])
                hessian += np.bincount(places[a] * size + places[b], own, size * size)
        hessian = hessian.reshape(size, size) + np.diag(ridge)
        step, scale = np.linalg.solve(hessian, gradient), 1.0
        while scale > 1e-6 and chances(theta + scale * step)[1] < now:
            scale /= 2
        theta = theta + scale * step
        p, now = chances(theta)
        if np.abs(step).max() < tolerance:
            break
    else:
        warnings.warn(f"no convergence in {rounds} rounds", RuntimeWarning, stacklevel=2)
    error = np.sqrt(np.diag(np.linalg.inv(hessian)))[:n_items]
    return theta[:n_items] - theta[:n_items].mean(), error, theta[n_items], theta[n_items + 1]


def _at_pairs(pairs: DataFrame, items: DataFrame, keep: list[str], values: list[str]) -> DataFrame:
    """``pairs`` and the ``values`` of both their items, as a_ and b_; ``keep`` are further keys."""
    own = lambda side, mark: items.select(F.col("method").alias(side), *keep, *[F.col(v).alias(f"{mark}_{v}") for v in values])
    return pairs.join(own("first", "a"), "first").join(own("second", "b"), ["second", *keep])


def _to_items(rows: DataFrame, keep: list[str], sums: dict) -> DataFrame:
    """Per item the sums of what each row gives to its first and to its second item."""
    ends = [F.struct(F.col(side).alias("method"), *[v[i].alias(k) for k, v in sums.items()]) for i, side in enumerate(("first", "second"))]
    return rows.select(*keep, F.explode(F.array(*ends)).alias("e")).groupBy(*keep, "e.method").agg(*[F.sum(f"e.{k}").alias(k) for k in sums])


def _solve_joined(pairs: DataFrame, rhs: DataFrame, last: dict, order: np.ndarray, tolerance: float, rounds: int) -> tuple[DataFrame, dict]:
    """The solutions x of (Hessian) x = b for several right sides at once, by conjugate
    gradients with the diagonal as preconditioner.

    ``rhs`` has (c, method, b, h), c the number of the right side and h the diagonal; ``last``
    gives for each c the two entries of the first position and of draws, ``order`` is their
    square of the Hessian. A step is one pass: the pairs meet the direction of both items and
    are summed per item; the driver holds a few sums for each right side."""
    n, p = F.col("n"), [F.col(f"p{o}") for o in range(3)]
    spark, zero, scale = rhs.sparkSession, F.lit(0.0), np.diag(order)
    x = rhs.select("c", "method", zero.alias("x"), F.col("b").alias("r"), (F.col("b") / F.col("h")).alias("d"), "h")
    lx, lr = {c: np.zeros(2) for c in last}, {c: np.array(v, float) for c, v in last.items()}
    ld, start = {c: v / scale for c, v in lr.items()}, {}
    for _ in range(rounds):
        sides = F.broadcast(spark.createDataFrame([(c, float(d[0]), float(d[1])) for c, d in ld.items()], "c int, u double, v double"))
        # One row for each right side, of which a block has BLOCK.
        at = _at_pairs(pairs, x.select("c", "method", "d"), ["c"], ["d"]).join(sides, "c")
        s = [F.col("a_d") + F.col("u"), F.col("b_d"), (F.col("a_d") + F.col("u") + F.col("b_d")) / 2 + F.col("v")]
        mean = p[0] * s[0] + p[1] * s[1] + p[2] * s[2]
        k = [n * p[o] * (s[o] - mean) for o in range(3)]
        own = _to_items(at, ["c"], {"q": (k[0] + k[2] / 2, k[1] + k[2] / 2), "u": (k[0] + k[2] / 2, zero), "v": (k[2], zero)})
        q = (F.coalesce("q", zero) + PENALTY * F.col("d")).alias("q")
        x = stored(x.join(own, ["c", "method"], "left").select("c", "method", "x", "r", "d", "h", q, "u", "v"))
        product = lambda a, b: F.sum(F.col(a) * F.col(b) / F.col("h"))
        sums = x.groupBy("c").agg(product("r", "r").alias("rr"), product("r", "q").alias("rq"), product("q", "q").alias("qq"), F.sum(F.col("d") * F.col("q")).alias("dq"), F.sum("u").alias("u"), F.sum("v").alias("v")).collect()
        steps, open_ = [], False
        for r in sums:
            c, ends = r.c, np.array([r.u, r.v]) + PENALTY_ORDER * ld[r.c]
            energy, curve = r.rr + float((lr[c] ** 2 / scale).sum()), r.dq + float(ld[c] @ ends)
            if energy <= tolerance**2 * start.setdefault(c, energy) or curve <= 0:
                steps.append((c, 0.0, 0.0))
                ld[c] = np.zeros(2)
                continue
            open_ = True
            step = energy / curve
            lx[c], lr[c] = lx[c] + step * ld[c], lr[c] - step * ends
            after = max(r.rr - 2 * step * r.rq + step * step * r.qq, 0.0) + float((lr[c] ** 2 / scale).sum())
            ld[c] = lr[c] / scale + after / energy * ld[c]
            steps.append((c, float(step), after / energy))
        moves = F.broadcast(spark.createDataFrame(steps, "c int, step double, ratio double"))
        r = F.col("r") - F.col("step") * F.col("q")
        # A solved side has step and ratio 0 and its direction stays 0 from then on.
        x = x.join(moves, "c").select(
            "c", "method", (F.col("x") + F.col("step") * F.col("d")).alias("x"), r.alias("r"), F.when(F.col("step") == 0, 0.0).otherwise(r / F.col("h") + F.col("ratio") * F.col("d")).alias("d"), "h"
        )
        if not open_:
            break
    else:
        warnings.warn(f"no convergence in {rounds} rounds", RuntimeWarning, stacklevel=2)
    return x.select("c", "method", "x"), lx


def fit_joined(counts: DataFrame, rounds: int = 100, tolerance: float = 1e-6, inner: int = 500) -> DataFrame:
    """``newton`` for one dimension of any size: (method, strength, error, first_effect,
    draw_effect).

    The same steps, each solved by conjugate gradients whose products are joins of the pairs
    with the items and sums per item; the errors, the diagonal of the inverse Hessian, are
    solved for BLOCK items at a time. The driver holds the two parameters of order and draws
    and a few numbers for each right side, never the items."""
    from corpuskit.operators.ordered import numbered

    total = F.col("wins") + F.col("losses") + F.col("draws")
    counts = stored(counts.select("first", "second", "wins", "losses", "draws", total.alias("n")))
    names = counts.select(F.col("first").alias("method")).union(counts.select("second")).distinct()
    # Places, for the errors, are given once.
    items = stored(numbered(names, ["method"]).select("method", "rn", F.lit(0.0).alias("t")))
    order = np.zeros(2)
    left = [F.col(k) - F.col("n") * F.col(f"p{o}") for o, k in enumerate(("wins", "losses", "draws"))]
    p0, p2, n = F.col("p0") + F.col("p2") / 2, F.col("p2"), F.col("n")
    spread = lambda o: n * (F.col(f"p{o}") + p2 / 4 - (F.col(f"p{o}") + p2 / 2) ** 2)

    def measured(items, order):
        """Pairs with their chances; value and derivatives of the penalised log likelihood."""
        z = _at_pairs(counts, items.select("method", "t"), [], ["t"])
        s = [F.col("a_t") + float(order[0]), F.col("b_t"), (F.col("a_t") + float(order[0]) + F.col("b_t")) / 2 + float(order[1])]
        top = F.greatest(*s)
        sums = F.exp(s[0] - top) + F.exp(s[1] - top) + F.exp(s[2] - top)
        likelihood = F.col("wins") * s[0] + F.col("losses") * s[1] + F.col("draws") * s[2] - n * (top + F.log(sums))
        z = stored(z.select("first", "second", "wins", "losses", "draws", "n", *[(F.exp(s[o] - top) / sums).alias(f"p{o}") for o in range(3)], likelihood.alias("value")))
        got = z.agg(F.sum("value"), F.sum(left[0] + left[2] / 2), F.sum(left[2]), F.sum(spread(0)), F.sum(n * (p2 / 2 - p0 * p2)), F.sum(n * p2 * (1 - p2))).first()
        value = got[0] - 0.5 * PENALTY * items.agg(F.sum(F.col("t") * F.col("t"))).first()[0] - 0.5 * PENALTY_ORDER * float(order @ order)
        square = np.array([[got[3], got[4]], [got[4], got[5]]]) + PENALTY_ORDER * np.eye(2)
        return z, value, np.array(got[1:3], float) - PENALTY_ORDER * order, square

    z, now, slope, square = measured(items, order)
    moved = np.inf
    for _ in range(rounds):
        own = _to_items(z, [], {"g": (left[0] + left[2] / 2, left[1] + left[2] / 2), "h": (spread(0), spread(1))})
        rhs = items.join(own, "method").select(F.lit(0).alias("c"), "method", (F.col("g") - PENALTY * F.col("t")).alias("b"), (F.col("h") + PENALTY).alias("h"))
        rhs = stored(rhs)
        # The nearer the maximum, the more exact the step need be.
        x, last = _solve_joined(z.drop("value"), rhs, {0: slope}, square, max(1e-6, min(0.1, moved) ** 2), inner)
        x, scale = stored(x.select("method", "x")), 1.0
        while True:
            new = stored(items.join(x, "method").select("method", "rn", (F.col("t") + scale * F.col("x")).alias("t")))
            got = measured(new, order + scale * last[0])
            if got[1] >= now - 1e-9 * abs(now) or scale <= 1e-6:
                break
            scale /= 2
        moved = max(x.agg(F.max(F.abs("x"))).first()[0], np.abs(last[0]).max())
        items, order, (z, now, slope, square) = new, order + scale * last[0], got
        if moved < tolerance:
            break
    else:
        warnings.warn(f"no convergence in {rounds} rounds", RuntimeWarning, stacklevel=2)
    # The errors: one right side for each item, BLOCK of them at a time.
    h = stored(_to_items(z, [], {"h": (spread(0), spread(1))}).withColumn("h", F.col("h") + PENALTY))
    errors, many = None, items.count()
    for begin in range(0, many, BLOCK):
        c = (F.col("rn") - 1 - begin).cast("int")
        own = items.filter((F.col("rn") > begin) & (F.col("rn") <= begin + BLOCK)).select(c.alias("c"), F.col("method").alias("of"))
        width = min(BLOCK, many - begin)
        each = h.select("method", "h", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("c"))
        sides = each.join(F.broadcast(own), "c").select("c", "method", (F.col("method") == F.col("of")).cast("double").alias("b"), "h")
        x, _ = _solve_joined(z.drop("value"), stored(sides), {c: np.zeros(2) for c in range(width)}, square, 1e-7, inner)
        got = stored(x.join(F.broadcast(own), "c").filter("method = of").select("method", F.sqrt("x").alias("error")))
        errors = got if errors is None else errors.unionByName(got)
    mean = items.agg(F.avg("t")).first()[0]
    out = items.join(errors, "method")
    return out.select("method", (F.col("t") - mean).alias("strength"), "error", F.lit(float(order[0])).alias("first_effect"), F.lit(float(order[1])).alias("draw_effect"))


_FIT = "dimension string, method string, strength double, error double, first_effect double, draw_effect double, rank int"


def ranking(counts: DataFrame) -> DataFrame:
    """(dimension, method, strength, error, first_effect, draw_effect, rank, n_answers).

    Rank 1 is the strongest; equal strengths (to nine digits) rank by name. A method without
    any answer on a dimension has no row there. The driver takes the counts of a dimension
    where its items number at most DENSE_ITEMS and its pairs at most DENSE_PAIRS; beyond, the
    same maximum and the same errors come from joins.
    """
    from corpuskit.operators.ordered import numbered

    spark = counts.sparkSession
    counts = cut(counts)
    n = F.col("wins") + F.col("losses") + F.col("draws")
    answered = counts.select("dimension", F.col("first").alias("method"), n.alias("n")).union(counts.select("dimension", "second", n)).groupBy("dimension", "method").agg(F.sum("n").alias("n_answers"))
    answered = cut(answered)
    sizes = answered.groupBy("dimension").agg(F.count("*").alias("items")).join(counts.groupBy("dimension").agg(F.count("*").alias("pairs")), "dimension")
    done, parts = [], []
    for dimension, items, pairs in sizes.orderBy("dimension").collect():
        own = counts.filter(F.col("dimension") == dimension)
        if items > DENSE_ITEMS or pairs > DENSE_PAIRS:
            got = fit_joined(own.drop("dimension")).withColumn("back", -F.round("strength", 9))
            ranked = numbered(got, ["back", "method"]).select(F.lit(dimension).alias("dimension"), "method", "strength", "error", "first_effect", "draw_effect", F.col("rn").cast("int").alias("rank"))
            parts.append(ranked)
            continue
        got = own.orderBy("first", "second").toPandas()
        names = sorted({*got["first"], *got["second"]})
        place = {name: i for i, name in enumerate(names)}
        t, error, d, v = newton(
            got["first"].map(place).to_numpy(), got["second"].map(place).to_numpy(), got[["wins", "losses", "draws"]].to_numpy(float), len(names)
        )
        best = sorted(range(len(names)), key=lambda i: (-round(t[i], 9), names[i]))
        done += [(dimension, names[i], float(t[i]), float(error[i]), float(d), float(v), k) for k, i in enumerate(best, 1)]
    out = spark.createDataFrame(done, _FIT)
    for p in parts:
        out = out.unionByName(p)
    return out.join(answered, ["dimension", "method"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four strongest methods of each dimension."""
    counts = outcome_counts(read_table(spark, sf_dir, "preferences"), read_table(spark, sf_dir, "comparisons"))
    return ranking(counts).filter("rank <= 4").select("dimension", "method")


def p7_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = outcome_counts(read_table(spark, sf_dir, "preferences"), read_table(spark, sf_dir, "comparisons"))
    return ranking(counts)
