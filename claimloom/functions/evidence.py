"""Evidence algebra as native expressions.

A mass on a binary frame is a struct: ``m0`` and ``m1`` on the hypotheses, ``th`` on both,
``cf`` on the conflict (empty set), ``ms`` on the missing (complement of both). On any
frame it is an array of (mask, neg, m): a bit for each hypothesis, and whether the
element is the complement of its set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this a conflict counts as none, and as total within this of 1.
TINY = 1e-9
#: Names that ``redistribute`` knows.
RULES = ("conjunctive", "tbm_conjunctive", "dempster", "yager_open", "yager_closed", "dubois_prade", "inagaki")


def unit(x: Column) -> Column:
    """x onto [0, 1]; NaN and -0.0 become 0."""
    return F.when(F.isnan(x) | (x <= 0), F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    """x onto [low, high]; null stays null, which greatest and least would lose."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


# -- binary frame -------------------------------------------------------------------------


def binary(m0: Column, m1: Column, th: Column, cf: Column | None = None, ms: Column | None = None) -> Column:
    return F.struct(m0.alias("m0"), m1.alias("m1"), th.alias("th"), (F.lit(0.0) if cf is None else cf).alias("cf"), (F.lit(0.0) if ms is None else ms).alias("ms"))


def discount(m: Column, alpha: Column) -> Column:
    """All but the whole frame keeps alpha of its mass; the frame gets the rest."""
    return binary(alpha * m["m0"], alpha * m["m1"], alpha * m["th"] + (1 - alpha), alpha * m["cf"], alpha * m["ms"])


def conflict(a: Column, b: Column) -> Column:
    """Mass of all pairs that meet in the empty set."""
    pos_a, pos_b = a["m0"] + a["m1"] + a["th"], b["m0"] + b["m1"] + b["th"]
    return a["m0"] * b["m1"] + a["m1"] * b["m0"] + a["cf"] * (pos_b + b["cf"] + b["ms"]) + b["cf"] * (pos_a + a["ms"]) + a["ms"] * pos_b + b["ms"] * pos_a


def conjunctive(a: Column, b: Column) -> Column:
    """Unnormalised: conflict and missing are kept."""
    return binary(
        a["m0"] * (b["m0"] + b["th"]) + a["th"] * b["m0"], a["m1"] * (b["m1"] + b["th"]) + a["th"] * b["m1"], a["th"] * b["th"], conflict(a, b), a["ms"] * b["ms"]
    )


def _scaled(m: Column, by: Column, ms: Column | None = None) -> Column:
    """Without conflict, the rest scaled."""
    return binary(m["m0"] * by, m["m1"] * by, m["th"] * by, F.lit(0.0), m["ms"] * by if ms is None else ms)


def dempster(a: Column, b: Column) -> Column:
    """Conflict is normalised away; null where it is total."""
    m, k = conjunctive(a, b), conflict(a, b)
    return F.when(F.abs(k - 1) >= TINY, _scaled(m, 1 / (1 - k)))


def yager_closed(a: Column, b: Column) -> Column:
    """Conflict becomes ignorance of the frame."""
    m = conjunctive(a, b)
    return binary(m["m0"], m["m1"], m["th"] + m["cf"], F.lit(0.0), m["ms"])


def yager_open(a: Column, b: Column) -> Column:
    """Conflict becomes missing mass: the answer may lie outside the frame."""
    m = conjunctive(a, b)
    return binary(m["m0"], m["m1"], m["th"], F.lit(0.0), m["ms"] + m["cf"])


def dubois_prade(a: Column, b: Column) -> Column:
    """Each conflicting pair's mass goes to its union; for positive masses that is the frame."""
    return yager_closed(a, b)


def inagaki(a: Column, b: Column, gamma: float) -> Column:
    """gamma of the conflict becomes missing mass, the rest is shared in proportion."""
    m, k = conjunctive(a, b), conflict(a, b)
    rest = m["m0"] + m["m1"] + m["th"] + m["ms"]
    by = F.when(rest > TINY, 1 + (1 - gamma) * k / rest).otherwise(F.lit(1.0))
    lost = F.when(rest < TINY, (1 - gamma) * k).otherwise(F.lit(0.0))
    return F.when(k < TINY, m).otherwise(_scaled(m, by, m["ms"] * by + gamma * k + lost))


def redistribute(a: Column, b: Column, method: Column, gamma: float = 0.5) -> Column:
    """Two masses combined by a named rule; null for a name that is none, and for total conflict under Dempster's.

    All rules scale the conjunctive result and differ in where its conflict goes.
    """

    def chosen(x: Column) -> Column:
        m, k, rest, how = x["m"], x["m"]["cf"], x["rest"], x["method"]
        split = (how == "inagaki") & (k >= TINY)
        by = F.when(how == "dempster", 1 / (1 - k)).when(split & (rest > TINY), 1 + (1 - gamma) * k / rest).otherwise(F.lit(1.0))
        frame = F.when(how.isin("yager_closed", "dubois_prade"), k).otherwise(F.lit(0.0))
        kept = F.when(how.isin("conjunctive", "tbm_conjunctive") | ((how == "inagaki") & (k < TINY)), k).otherwise(F.lit(0.0))
        lost = F.when(how == "yager_open", k).when(split, gamma * k + F.when(rest < TINY, (1 - gamma) * k).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))
        known = how.isin(*RULES) & ~((how == "dempster") & (F.abs(k - 1) < TINY))
        return F.when(known, _bound(by, lambda by: binary(m["m0"] * by, m["m1"] * by, m["th"] * by + frame, kept, m["ms"] * by + lost)))

    both = F.struct(a.alias("a"), b.alias("b"))
    m = _bound(both, lambda x: conjunctive(x["a"], x["b"]))
    return _bound(m, lambda m: _bound(F.struct(m.alias("m"), (m["m0"] + m["m1"] + m["th"] + m["ms"]).alias("rest"), method.alias("method")), chosen))


def cautious(a: Column, b: Column) -> Column:
    """Least of the commonalities, turned back into masses; for masses without complements."""
    q0, q1 = F.least(a["m0"] + a["th"], b["m0"] + b["th"]), F.least(a["m1"] + a["th"], b["m1"] + b["th"])
    qt = F.least(a["th"], b["th"])
    some = lambda x: F.when(x > 1e-12, x).otherwise(F.lit(0.0))
    return binary(some(q0 - qt), some(q1 - qt), some(qt), some(1 - q0 - q1 + qt))


def rule(k: Column, open_world: Column) -> Column:
    """The rule that a conflict and an open-world share call for."""
    return F.when(k < 0.1, "dempster").when(k < 0.5, "conjunctive").when(open_world > 0.03, "yager_open").otherwise("inagaki")


def _bound(x: Column, body) -> Column:
    """``body`` of a value that is computed once: higher-order functions share no subexpressions."""
    return F.element_at(F.transform(F.array(x), body), 1)


def adaptive_step(a: Column, b: Column) -> Column:
    """One step of the fold over a claim's masses. Open-world conflict goes to the missing mass."""

    def chosen(x: Column) -> Column:
        m, k, rest = x["m"], x["m"]["cf"], x["rest"]
        low = F.when(rest < TINY, 0.5 * k).otherwise(F.lit(0.0))
        by = F.when(k < 0.1, 1 / (1 - k)).when((k < 0.5) | (x["open"] > 0.03) | (rest <= TINY), F.lit(1.0)).otherwise(1 + 0.5 * k / rest)
        kept = F.when((k >= 0.1) & (k < 0.5), k).otherwise(F.lit(0.0))
        lost = F.when(k < 0.5, F.lit(0.0)).when(x["open"] > 0.03, k).otherwise(0.5 * k + low)
        return _bound(by, lambda by: binary(m["m0"] * by, m["m1"] * by, m["th"] * by, kept, m["ms"] * by + lost))

    m = conjunctive(a, b)
    return _bound(m, lambda m: _bound(F.struct(m.alias("m"), (m["m0"] + m["m1"] + m["th"] + m["ms"]).alias("rest"), a["ms"].alias("open")), chosen))


def canonical(m: Column) -> Column:
    """Sort key of a positive binary mass: by sets in order {0}, {0,1}, {1}, then mass."""
    held = [F.when(m[f] > 0, F.struct(F.lit(i).alias("set"), m[f].alias("m"))) for i, f in enumerate(("m0", "th", "m1"))]
    return F.array_compact(F.array(*held))


def fold(masses: Column) -> Column:
    """The masses of a claim combined in canonical order, whatever order they come in."""
    ordered = F.transform(F.array_sort(F.transform(masses, lambda m: F.struct(canonical(m).alias("key"), m.alias("m")))), lambda x: x["m"])
    return F.when(F.size(masses) > 0, F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))), F.element_at(ordered, 1), adaptive_step))


def measures(m: Column) -> dict[str, Column]:
    """Belief, plausibility and pignistic probability of hypothesis 0, and more."""
    outside = m["cf"] + m["ms"]
    share = lambda x: F.when(F.abs(outside - 1) < TINY, F.lit(0.0)).otherwise(unit((x + m["th"] / 2) / (1 - outside)))
    bel, pl = unit(m["m0"]), unit(m["m0"] + m["th"])
    return {"belief": bel, "plausibility": pl, "ignorance": pl - bel, "betp": share(m["m0"]), "betp_unsup": share(m["m1"]), "conflict": m["cf"], "missing": m["ms"], "theta": m["th"]}


def classify(conflict_k: Column, theta: Column, betp: Column, unsup: Column, opposing: Column, *, nei: float, support: float, limit: float) -> Column:
    """The cascade of seven rules; the fourth needs a threshold of 0 or less."""
    out = F.when((conflict_k >= limit) & opposing, "contradicted").when((unsup > betp) & (unsup >= support), "contradicted").when((theta > nei) & (conflict_k < limit), "not_enough_info")
    if nei <= 0:
        return out.when(betp >= unsup, "supported").otherwise("contradicted")
    return out.when((betp >= support) & (conflict_k < limit), "supported").when((conflict_k >= limit * 0.5) & (betp < support), "contradicted").otherwise("not_enough_info")


def conformal(betp: Column, unsup: Column, theta: Column, q: dict[str, float]) -> Column:
    """All classes whose score is within its quantile; may be empty."""
    scores = {"supported": 1 - betp, "contradicted": 1 - unsup, "not_enough_info": 1 - theta}
    return F.array_compact(F.array(*[F.when(s <= q[k], F.lit(k)) for k, s in scores.items()]))


# -- any frame ------------------------------------------------------------------------------


def element(mask: Column, neg: Column, m: Column) -> Column:
    return F.struct(mask.cast("int").alias("mask"), neg.alias("neg"), m.alias("m"))


def intersect(a: Column, b: Column) -> Column:
    """Meeting of two focal elements (mask, neg)."""
    x, y = a["mask"], b["mask"]
    mask = F.when(~a["neg"] & ~b["neg"], x.bitwiseAND(y)).when(~a["neg"], x.bitwiseAND(F.bitwise_not(y))).when(~b["neg"], y.bitwiseAND(F.bitwise_not(x))).otherwise(x.bitwiseOR(y))
    return F.struct(mask.alias("mask"), (a["neg"] & b["neg"]).alias("neg"))


def _total(masses: Column, keep) -> Column:
    return F.aggregate(F.filter(masses, keep), F.lit(0.0), lambda s, e: s + e["m"])


def belief(masses: Column, target: Column) -> Column:
    return unit(_total(masses, lambda e: ~e["neg"] & (e["mask"] != 0) & (e["mask"].bitwiseAND(F.bitwise_not(target)) == 0)))


def plausibility(masses: Column, target: Column) -> Column:
    return unit(_total(masses, lambda e: ~e["neg"] & (e["mask"].bitwiseAND(target) != 0)))


def commonality(masses: Column, target: Column) -> Column:
    return _total(masses, lambda e: ~e["neg"] & (e["mask"].bitwiseAND(target) == target))


def pignistic(masses: Column, hypothesis: int) -> Column:
    """Normalised by all mass that is not on non-empty positive sets."""
    outside = _total(masses, lambda e: e["neg"] | (e["mask"] == 0))
    bit = F.lit(1 << hypothesis)
    held = F.aggregate(F.filter(masses, lambda e: ~e["neg"] & (e["mask"].bitwiseAND(bit) != 0)), F.lit(0.0), lambda s, e: s + e["m"] / F.bit_count(e["mask"]))
    return F.when(F.abs(outside - 1) < TINY, F.lit(0.0)).otherwise(unit(held / (1 - outside)))


def to_classical(masses: Column, hypotheses: int) -> Column:
    """Complements as the positive sets that they are within the frame."""
    full = F.lit((1 << hypotheses) - 1)
    return F.transform(masses, lambda e: element(F.when(e["neg"], full.bitwiseAND(F.bitwise_not(e["mask"]))).otherwise(e["mask"]), F.lit(False), e["m"]))


def beta_mass(alpha: Column, beta: Column) -> Column:
    """Mass for, against (as a complement) and vacuous from counts of a Beta distribution."""
    total = alpha + beta
    s = F.when(total < 1e-12, F.lit(0.0)).otherwise(1 - 2 / (total + 2))
    return F.struct((F.when(total > 0, alpha / total).otherwise(0.0) * s).alias("m_for"), (F.when(total > 0, beta / total).otherwise(0.0) * s).alias("m_against"), (1 - s).alias("m_vacuous"))


# -- intervals and updates -------------------------------------------------------------------


def interval_mass(bel: Column, pl: Column, open_world: Column) -> Column:
    """An interval as a binary mass."""
    bel, pl = unit(bel), unit(pl)
    width = F.greatest(pl - bel, F.lit(0.0))
    ow = F.least(F.greatest(open_world, F.lit(0.0)), width)
    return binary(bel, F.greatest(1 - pl, F.lit(0.0)), F.greatest(width - ow, F.lit(0.0)), F.lit(0.0), ow)


def restrict(bel: Column, pl: Column, factor: Column) -> tuple[Column, Column]:
    """The interval that a neighbour expects through a signed factor."""
    f = F.abs(factor)
    return F.when(factor > 0, bel * f).otherwise((1 - pl) * f), F.when(factor > 0, 1 - (1 - pl) * f).otherwise(1 - bel * f)


def directed_mass(supports: Column, support: Column, against: Column, weight: Column, confidence: Column, kept: Column, open_world: float) -> dict[str, Column]:
    """Mass of one piece of evidence; ``kept`` is what section, journal and uncertainty leave of the asserted side."""
    strong = F.least(support * weight * confidence, F.lit(0.95))
    weak = F.least(against * (1 - confidence * 0.5), F.lit(0.3))
    theta = F.greatest(1 - strong - weak, F.lit(0.0)) + strong * (1 - kept)
    strong = strong * kept
    scale = (1 - open_world) / (strong + weak + theta)
    return {"m_sup": F.when(supports, strong).otherwise(weak) * scale, "m_unsup": F.when(supports, weak).otherwise(strong) * scale, "m_theta": theta * scale, "m_open": F.lit(float(open_world))}


def error_mass(effect: Column, random: Column, systematic: Column, scope: Column) -> dict[str, Column]:
    """Evidence, ignorance and open-world mass of an experiment's error budget."""
    total = F.greatest(F.sqrt(random * random + systematic * systematic), F.lit(1e-10))
    strength = 1 - F.exp(-0.5 * (effect / total) * (effect / total))
    part = systematic * systematic / (total * total)
    ow = F.least(scope, F.lit(0.30))
    return {"precision_ratio": effect / total, "strength": strength, "systematic_fraction": part, "m_open": ow, "m_evidence": (1 - ow) * strength * (1 - part), "m_theta": (1 - ow) * (strength * part + 1 - strength)}


def bayes(prior: Column, if_true: Column, if_false: Column, low: float = 0.01, high: float = 0.99) -> Column:
    """Posterior, held within [low, high]; null where the evidence is all but impossible."""
    p = if_true * prior + if_false * (1 - prior)
    return F.when(p >= 2.220446049250313e-16, clip(if_true * prior / p, low, high))


def bayes_step(prior: Column, strength: Column, supports: Column) -> Column:
    up, down = 0.5 + 0.5 * strength, 0.5 - 0.4 * strength
    return bayes(prior, F.when(supports, up).otherwise(down), F.when(supports, down).otherwise(up))


def initial_truth(weight: Column, pieces: Column) -> Column:
    bonus = F.when(pieces <= 0, 0.0).when(pieces == 1, 0.1).when(pieces == 2, 0.15).when(pieces == 3, 0.18).otherwise(0.2)
    return F.least(0.5 + 0.5 * weight + bonus, F.lit(0.85))


def combined_weight(weights: Column) -> Column:
    """Largest first, each next at half the rate."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("f"))
    total = F.aggregate(F.sort_array(weights, asc=False), start, lambda a, w: F.struct((a["s"] + w * a["f"]).alias("s"), (a["f"] * 0.5).alias("f")))
    return F.least(total["s"] / 2, F.lit(1.0))


def bernoulli_kl(p: Column, q: Column, eps: float = 1e-10) -> Column:
    p, q = (F.greatest(F.least(x, F.lit(1 - eps)), F.lit(eps)) for x in (p, q))
    return p * F.ln(p / q) + (1 - p) * F.ln((1 - p) / (1 - q))


NUMBER = r"(\d+(?:\.\d+)?)"


def uncertainty(text: Column) -> Column:
    """Relative uncertainty read from prose: the first form that matches.

    ±%, (v ± e), v ± e, CI [lo, hi], p-values; null without any.
    """

    def get(pattern: str, i: int = 1) -> Column:
        return F.regexp_extract(text, pattern, i).cast("double")

    def held(x: Column) -> Column:
        return clip(x, 0.01, 0.99)

    def relative(pattern: str) -> Column:
        return F.when(get(pattern) != 0, held(F.abs(get(pattern, 2) / get(pattern))))

    percent, paren, plain = rf"±\s*{NUMBER}\s*%", rf"\(\s*{NUMBER}\s*±\s*{NUMBER}\s*\)", rf"{NUMBER}\s*±\s*{NUMBER}"
    ci, p = rf"(?i)(?:\d+%?\s*)?CI\s*\[\s*{NUMBER}\s*,\s*{NUMBER}\s*\]", r"(?i)p\s*[<>=≤≥]+\s*(\d*\.?\d+)"
    mid = (get(ci) + get(ci, 2)) / 2
    by_p = F.when(get(p) <= 0.001, 0.05).when(get(p) <= 0.01, 0.10).when(get(p) <= 0.05, 0.20).otherwise(held(0.4 + get(p)))
    return (
        F.when(text.rlike(percent), held(get(percent) / 100))
        .when(text.rlike(paren), relative(paren))
        .when(text.rlike(plain), relative(plain))
        .when(text.rlike(ci), F.when(mid != 0, held(F.abs((get(ci, 2) - get(ci)) / mid))))
        .when(text.rlike(p), by_p)
    )
