"""Belief propagation and consistency over factors and edges.

A factor is a row (a, b, kind, forward, reverse): two variables, a potential, and its strengths
towards b and towards a. All messages of a round come from the beliefs of the round before,
so a round is joins and one aggregate; rounds are written to shared storage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calibration as K
from ..functions import evidence as E
from ..session import Rounds, stored


def factors(edges: DataFrame) -> DataFrame:
    """Factors of edges (source_id, target_id, relationship); relationships without one are dropped."""
    part = lambda i: K.lookup({k: v[i] for k, v in K.FACTOR.items()}, F.col("relationship"))
    out = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), part(0).alias("kind"), part(1).alias("forward"), part(2).alias("reverse"))
    return out.where("kind IS NOT NULL").distinct()


def message(kind: Column, strength: Column, other: Column, own: Column, towards_b: bool) -> Column:
    """What a factor tells one of its two variables, from the other's belief."""
    return (
        F.when(kind == "mutual_exclusion", 1 - other)
        .when(kind.isin("evidential_support", "shared_evidence"), strength * other)
        .when(kind == "directional_support", F.when(strength < 1e-9, F.lit(0.5)).otherwise(strength * other))
        .when(kind == "conditional_dependence", other * strength + own * (1 - strength) if towards_b else own)
        .when(kind == "temporal_ordering", F.when(other > strength, other).otherwise(F.lit(0.5)) if towards_b else F.lit(0.5))
        .otherwise(F.lit(0.5))
    )


def _held(x: Column) -> Column:
    return E.clip(x, 0.01, 0.99)


def _mean(x: Column) -> Column:
    """Geometric mean, so that the number of factors does not matter."""
    return _held(F.exp(F.avg(F.ln(F.greatest(x, F.lit(1e-12))))))


def _joined(fac: DataFrame, now: DataFrame, cols: list[str]) -> DataFrame:
    """Factors with the state of both variables: a_x, b_x for each column x; unknown variables are null."""
    side = lambda v: now.select(F.col("var").alias(v), *[F.col(c).alias(f"{v}_{c}") for c in cols])
    return fac.join(side("a"), "a", "left").join(side("b"), "b", "left")


def scalar_bp(fac: DataFrame, priors: DataFrame, *, damping: float = 0.5, tolerance: float = 0.01, rounds: int = 20) -> DataFrame:
    """(var, belief) after loopy propagation from (var, prior); variables without factors keep theirs."""
    fac, held = stored(fac, "factors"), Rounds(fac.sparkSession, "beliefs")
    now = held.put(priors.select("var", "prior", F.col("prior").alias("belief")))
    for _ in range(rounds):
        x = _joined(fac, now, ["belief"])
        a, b = F.coalesce("a_belief", F.lit(0.5)), F.coalesce("b_belief", F.lit(0.5))
        to_a = x.select(F.col("a").alias("var"), message(F.col("kind"), F.col("reverse"), b, a, False).alias("m"))
        to_b = x.select(F.col("b").alias("var"), message(F.col("kind"), F.col("forward"), a, b, True).alias("m"))
        signal = to_a.unionAll(to_b).groupBy("var").agg(_mean(F.col("m")).alias("signal"))
        raw = 0.5 * F.col("prior") + 0.5 * F.col("signal")
        new = now.join(signal, "var", "left").select("var", "prior", F.coalesce(_held(damping * F.col("belief") + (1 - damping) * raw), "belief").alias("belief"), F.col("belief").alias("old"))
        new = held.put(new)
        change = new.agg(F.max(F.abs(F.col("belief") - F.col("old")))).first()[0] or 0.0
        now = new.drop("old")
        if change < tolerance:
            break
    return now.select("var", "belief")


def interval_bp(fac: DataFrame, priors: DataFrame, *, damping: float = 0.5, tolerance: float = 0.01, rounds: int = 20) -> DataFrame:
    """As scalar_bp on (var, bel, pl, ow). Kinds with a direction leave a variable's own interval."""
    fac, held = stored(fac, "factors"), Rounds(fac.sparkSession, "intervals")
    now = held.put(priors.select("var", "bel", "pl", "ow", F.struct("bel", "pl", "ow").alias("p")))
    symmetric = F.col("kind").isin("evidential_support", "shared_evidence")

    def told(x: DataFrame, var: str, other: str) -> DataFrame:
        o = [F.coalesce(f"{other}_{c}", F.lit(d)) for c, d in (("bel", 0.0), ("pl", 1.0), ("ow", 0.0))]
        s = F.col("reverse" if var == "a" else "forward")
        own = lambda c, d: F.coalesce(f"{var}_{c}", F.lit(d))
        bel = F.when(F.col("kind") == "mutual_exclusion", 1 - o[1]).when(symmetric, o[0] * s).otherwise(own("bel", 0.0))
        pl = F.when(F.col("kind") == "mutual_exclusion", 1 - o[0]).when(symmetric, 1 - (1 - o[1]) * s).otherwise(own("pl", 1.0))
        ow = F.when((F.col("kind") == "mutual_exclusion") | symmetric, o[2]).otherwise(own("ow", 0.0))
        return x.select(F.col(var).alias("var"), bel.alias("mb"), pl.alias("mp"), ow.alias("mo"))

    for _ in range(rounds):
        x = _joined(fac, now.select("var", "bel", "pl", "ow"), ["bel", "pl", "ow"])
        signal = told(x, "a", "b").unionAll(told(x, "b", "a")).groupBy("var").agg(_mean(F.col("mb")).alias("sb"), _mean(F.col("mp")).alias("sp"), F.max("mo").alias("so"))
        damped = lambda c, s: F.coalesce(_held(damping * F.col(c) + (1 - damping) * (0.5 * F.col(f"p.{c}") + 0.5 * F.col(s))), F.col(c))
        new = now.join(signal, "var", "left").select("var", damped("bel", "sb").alias("bel"), damped("pl", "sp").alias("pl"), F.greatest(F.coalesce("so", "ow"), F.col("p.ow")).alias("ow"), "p", F.greatest(F.abs(damped("bel", "sb") - F.col("bel")), F.abs(damped("pl", "sp") - F.col("pl"))).alias("moved"))
        new = held.put(new)
        change = new.agg(F.max("moved")).first()[0] or 0.0
        now = new.drop("moved")
        if change < tolerance:
            break
    return now.select("var", "bel", "pl", "ow")


def closure_proposals(fac: DataFrame, priors: DataFrame, now: DataFrame, width: float = 0.3) -> DataFrame:
    """Narrow, closed variables next to open ones: what the former could close."""
    sure = priors.where((F.col("ow") < 0.1) & (F.col("pl") - F.col("bel") < width)).select(F.col("var").alias("source"), (1 - F.col("ow")).alias("reduction"), ((F.col("bel") + F.col("pl")) / 2 * (1 - F.col("pl") + F.col("bel"))).alias("confidence"))
    wide = now.where("ow > 0.3").select(F.col("var").alias("target"))
    ends = fac.select(F.col("a").alias("source"), F.col("b").alias("target")).union(fac.select("b", "a")).distinct()
    return ends.join(sure, "source").join(wide, "target")


def _adaptive(a: Column, b: Column, limit: float) -> Column:
    k, m = E.conflict(a, b), E.conjunctive(a, b)
    return F.when(k < limit, E._scaled(m, 1 / (1 - k))).otherwise(m)


def mass_bp(fac: DataFrame, evidence: DataFrame, *, damping: float = 0.5, limit: float = 0.3, tolerance: float = 0.01, rounds: int = 10) -> DataFrame:
    """(var, m) with binary masses as beliefs, from evidence (var, m).

    Messages of one variable are combined in the order of the sender, which makes the result
    independent of partitions; a variable's messages are as many as its factors.
    """
    vacuous = E.binary(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    fac, held = stored(fac, "factors"), Rounds(fac.sparkSession, "masses")
    now = held.put(evidence.select("var", "m", F.col("m").alias("e")))

    def told(x: DataFrame, var: str, other: str) -> DataFrame:
        o = F.coalesce(F.col(f"{other}_m"), vacuous)
        s = F.col("reverse" if var == "a" else "forward")
        betp = E.measures(o)["betp"]
        anti = E.binary(F.lit(0.0), betp, 1 - betp)
        positive = F.col("kind").isin("evidential_support", "shared_evidence", "directional_support") & (s >= 1e-9)
        m = F.when(F.col("kind") == "mutual_exclusion", anti).when(positive, E.discount(o, s)).otherwise(vacuous)
        return x.select(F.col(var).alias("var"), F.struct(F.col(other).alias("sender"), F.col("kind"), m.alias("m")).alias("t"))

    for _ in range(rounds):
        x = _joined(fac, now.select("var", "m"), ["m"])
        heard = told(x, "a", "b").unionAll(told(x, "b", "a")).groupBy("var").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["m"]).alias("ms"))
        graph = F.aggregate("ms", vacuous, lambda acc, m: _adaptive(acc, m, limit))
        mixed = now.join(heard, "var", "left").select("var", "e", F.col("m").alias("old"), F.when(F.col("ms").isNotNull(), graph).alias("g"))
        mixed = mixed.select("var", "e", "old", F.when(F.col("g").isNotNull(), _adaptive(F.col("g"), F.col("e"), limit)).alias("n"))
        part = lambda f: F.coalesce((1 - damping) * F.col("n")[f] + damping * F.col("old")[f], F.col("old")[f])
        new = mixed.select("var", "e", E.binary(*[part(f) for f in ("m0", "m1", "th", "cf", "ms")]).alias("m"), "old")
        new = held.put(new)
        change = new.agg(F.max(F.greatest(F.abs(F.col("m.m0") - F.col("old.m0")), F.abs(F.col("m.m0") + F.col("m.th") - F.col("old.m0") - F.col("old.th"))))).first()[0] or 0.0
        now = new.drop("old")
        if change < tolerance:
            break
    return now.select("var", "m")


def propagate(edges: DataFrame, truths: DataFrame, source: int, new_truth: float, *, max_depth: int = 10) -> DataFrame:
    """(claim_id, truth_value, depth) of the claims that a changed claim moves.

    Level by level: a claim is moved once, by the reached claim of the smallest id of the level
    before. ``edges`` (source_id, target_id, weight, supporting).
    """
    edges = stored(edges, "weighted")
    here = truths.where(F.col("claim_id") == source).select("claim_id", F.lit(float(new_truth)).alias("truth_value"), F.lit(0).alias("depth"))
    front = stored(here, "front")
    seen = front
    for depth in range(1, max_depth + 1):
        step = edges.join(front.select(F.col("claim_id").alias("source_id"), F.col("truth_value").alias("by")), "source_id").groupBy(F.col("target_id").alias("claim_id")).agg(F.min(F.struct("source_id", "supporting", "weight", "by")).alias("x"))
        step = step.join(seen.select("claim_id"), "claim_id", "left_anti").join(truths.select("claim_id", F.col("truth_value").alias("t")), "claim_id")
        w = F.greatest(F.least(F.col("x.weight") * F.col("x.by"), F.lit(1.0)), F.lit(0.01))
        moved = F.when(F.col("x.supporting"), F.col("t") + w * (1 - F.col("t")) * 0.1).otherwise(F.col("t") - w * F.col("t") * 0.1)
        front = stored(step.select("claim_id", E.unit(moved).alias("truth_value"), F.lit(depth).alias("depth")), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def sheaf_sections(edges: DataFrame, betp: DataFrame, profile: str = "scientific") -> DataFrame:
    """(node, local, expected, radius, neighbours): what a claim's sources make one expect of it."""
    f = K.restriction(F.col("relationship"), profile)
    e = edges.select("source_id", F.col("target_id").alias("node"), f.alias("f")).where("f IS NOT NULL").join(betp.select(F.col("node").alias("source_id"), F.col("betp").alias("s")), "source_id")
    want = e.groupBy("node").agg(F.avg(F.when(F.col("f") > 0, F.col("s") * F.col("f")).otherwise((1 - F.col("s")) * -F.col("f"))).alias("want"), F.count("*").alias("neighbours"))
    out = betp.join(want, "node", "left").withColumn("expected", F.coalesce("want", "betp"))
    return out.select("node", F.col("betp").alias("local"), "expected", F.abs(F.col("betp") - F.col("expected")).alias("radius"), F.coalesce("neighbours", F.lit(0)).cast("long").alias("neighbours"))


def sheaf_edges(edges: DataFrame, betp: DataFrame, profile: str = "scientific") -> DataFrame:
    """Each restricting edge with the one-sided excess of its target over what is expected."""
    f = F.col("f")
    side = lambda v, n: betp.select(F.col("node").alias(v), F.col("betp").alias(n))
    e = edges.withColumn("f", K.restriction(F.col("relationship"), profile)).where("f IS NOT NULL").join(side("source_id", "s"), "source_id").join(side("target_id", "t"), "target_id")
    e = e.withColumn("expected", F.when(f > 0, F.col("s") * f).otherwise(1 - F.col("s") * -f))
    return e.withColumn("inconsistency", F.greatest(F.when(f > 0, F.col("expected") - F.col("t")).otherwise(F.col("t") - F.col("expected")), F.lit(0.0)))


def interval_sections(edges: DataFrame, intervals: DataFrame, profile: str = "scientific") -> DataFrame:
    """Sections on intervals (node, bel, pl, ow)."""
    e = edges.select("source_id", F.col("target_id").alias("node"), K.restriction(F.col("relationship"), profile).alias("f")).where("f IS NOT NULL")
    e = e.join(intervals.select(F.col("node").alias("source_id"), "bel", "pl", "ow"), "source_id")
    low, high = E.restrict(F.col("bel"), F.col("pl"), F.col("f"))
    want = e.groupBy("node").agg(E.unit(F.avg(low)).alias("eb"), E.unit(F.avg(high)).alias("ep"), F.avg("ow").alias("eo"), F.count("*").alias("neighbours"))
    out = intervals.join(want, "node")
    return out.select("node", "eb", "ep", "eo", F.greatest(F.abs(F.col("bel") - F.col("eb")), F.abs(F.col("pl") - F.col("ep"))).alias("distance"), F.abs((F.col("pl") - F.col("bel")) - (F.col("ep") - F.col("eb"))).alias("ignorance"), "neighbours")
