"""Evidence algebra and belief, over one mass function for each line of an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calibration as K
from ..functions import evidence as E
from ..operators import combine as C
from ..sources.tables import Tables
from .registry import plan

R6 = lambda c: F.round(c, 6)
#: Added before rounding where exact halves are common, as two engines may sum to either side of them.
TIE = 1e-9


def alpha(weights: Column | None = None, intra: float = K.INTRA_LOCALITY) -> Column:
    weight = K.evidence_weight(F.col("evidence_type")) if weights is None else F.coalesce(weights, K.evidence_weight(F.col("evidence_type")))
    return C.effective_strength(F.col("evidence_type"), F.col("locality_tag"), F.col("source_strength"), weight, F.lit(intra))


def masses(t: Tables) -> DataFrame:
    """Each mass function with its effective strength, and discounted by it."""
    raw = E.binary(F.col("m_sup"), F.col("m_unsup"), 1 - F.col("m_sup") - F.col("m_unsup"))
    return t.bba.select("*", raw.alias("raw"), alpha().alias("alpha")).withColumn("m", E.discount(F.col("raw"), F.col("alpha")))


def pairs(t: Tables) -> DataFrame:
    """The first two mass functions of each claim."""
    order = F.struct("created_at", "evidence_key", "evidence_line", "agent_id", "m_sup", "m_unsup", "m")
    two = masses(t).groupBy("claim_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, 2).alias("x")).where(F.size("x") == 2)
    return two.select("claim_id", F.col("x")[0]["m"].alias("a"), F.col("x")[1]["m"].alias("b"))


def combined(t: Tables, *keys: str, rows: DataFrame | None = None) -> DataFrame:
    """Belief of each claim (and key). One group is the sources of one claim."""
    rows = masses(t) if rows is None else rows
    opposing = F.max((E.measures(F.col("raw"))["betp_unsup"] > K.OPPOSING).cast("int")) == 1
    got = C.folded(rows.groupBy("claim_id", *keys).agg(F.count("*").alias("n_sources"), F.collect_list("m").alias("m"), opposing.alias("has_opposing")), "m")
    x = E.measures(F.col("m"))
    label = E.classify(x["conflict"], x["theta"], x["betp"], x["betp_unsup"], F.col("has_opposing"), nei=K.NEI, support=K.SUPPORT, limit=K.CONFLICT)
    return got.select("claim_id", *keys, "n_sources", *[x[k].alias(k) for k in ("belief", "plausibility", "betp", "betp_unsup", "conflict", "missing", "theta")], label.alias("classification"))


WEIGHT = "CASE evidence_type WHEN 'empirical' THEN 1e0 WHEN 'testimonial' THEN 6e-1 END"
ALPHA = f"least(greatest({WEIGHT} * CASE WHEN locality_tag LIKE 'intra%' THEN 3e-1 ELSE 1e0 END, 0e0), 1e0)"
D_SQL = f"d AS (SELECT *, alpha * m_sup AS m0, alpha * m_unsup AS m1, alpha * (1 - m_sup - m_unsup) + (1 - alpha) AS th FROM (SELECT *, {ALPHA} AS alpha FROM bba) z)"
K_SQL = "(a.m0 * x.m1 + a.m1 * x.m0 + a.cf * (x.m0 + x.m1 + x.th) + a.ms * (x.m0 + x.m1 + x.th))"
_C0, _C1, _CT = "(a.m0 * (x.m0 + x.th) + a.th * x.m0)", "(a.m1 * (x.m1 + x.th) + a.th * x.m1)", "(a.th * x.th)"


def _packed(m0: str, m1: str, th: str, cf: str, ms: str) -> str:
    return f"struct_pack(m0 := {m0}, m1 := {m1}, th := {th}, cf := {cf}, ms := {ms})"


_BY = f"(1 + 5e-1 * {K_SQL} / ({_C0} + {_C1} + {_CT}))"
FOLD_SQL = f"""CASE WHEN {K_SQL} < 1e-1 THEN {_packed(f'{_C0} / (1 - {K_SQL})', f'{_C1} / (1 - {K_SQL})', f'{_CT} / (1 - {K_SQL})', '0e0', '0e0')}
 WHEN {K_SQL} < 5e-1 THEN {_packed(_C0, _C1, _CT, K_SQL, '0e0')}
 WHEN a.ms > 3e-2 THEN {_packed(_C0, _C1, _CT, '0e0', K_SQL)}
 ELSE {_packed(f'{_C0} * {_BY}', f'{_C1} * {_BY}', f'{_CT} * {_BY}', '0e0', f'5e-1 * {K_SQL}')} END"""


def belief_sql(keys: str = "", source: str = "d", extra: str = "", tail: str = "") -> str:
    """Fold and measures by claim and keys, in DuckDB's SQL."""
    by = ", ".join(str(i) for i in range(1, 2 + len([k for k in keys.split(",") if k.strip()])))
    k = f", {keys}" if keys else ""
    return f"""WITH {D_SQL}, {extra}
l AS (SELECT claim_id{k}, count(*) AS n_sources, max(CASE WHEN m_unsup + (1 - m_sup - m_unsup) / 2 > 1e-1 THEN 1 ELSE 0 END) = 1 AS opp,
  list(struct_pack(m0 := m0, m1 := m1, th := th, cf := 0e0, ms := 0e0) ORDER BY (CASE WHEN m0 > 0 THEN 0 ELSE 1 END), m0, th, m1) AS xs FROM {source} GROUP BY {by}),
f AS (SELECT claim_id{k}, n_sources, opp, list_reduce(xs, lambda a, x: {FOLD_SQL}) AS m FROM l),
v AS (SELECT claim_id{k}, n_sources, opp, m.cf AS conflict, m.ms AS missing, m.th AS theta, least(greatest(m.m0, 0e0), 1e0) AS belief, least(greatest(m.m0 + m.th, 0e0), 1e0) AS plausibility,
  CASE WHEN abs(m.cf + m.ms - 1) < 1e-9 THEN 0e0 ELSE least(greatest((m.m0 + m.th / 2) / (1 - m.cf - m.ms), 0e0), 1e0) END AS betp,
  CASE WHEN abs(m.cf + m.ms - 1) < 1e-9 THEN 0e0 ELSE least(greatest((m.m1 + m.th / 2) / (1 - m.cf - m.ms), 0e0), 1e0) END AS betp_unsup FROM f)
SELECT claim_id{k}, n_sources, round(belief, 6) AS belief, round(plausibility, 6) AS plausibility, round(betp, 6) AS betp, round(betp_unsup, 6) AS betp_unsup,
  round(conflict, 6) AS conflict, round(missing, 6) AS missing, round(theta, 6) AS theta,
  CASE WHEN conflict >= 5e-2 AND opp THEN 'contradicted' WHEN betp_unsup > betp AND betp_unsup >= 15e-2 THEN 'contradicted'
       WHEN theta > 85e-2 AND conflict < 5e-2 THEN 'not_enough_info' WHEN betp >= 15e-2 AND conflict < 5e-2 THEN 'supported'
       WHEN conflict >= 25e-3 AND betp < 15e-2 THEN 'contradicted' ELSE 'not_enough_info' END AS classification FROM v{tail}"""


def rounded(df: DataFrame) -> DataFrame:
    """To six digits by way of the millionfold, as the SQL engine rounds; a decimal half would go the other way in some rows."""
    return df.select(*[(F.round(F.col(c) * 1e6) / 1e6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@plan(belief_sql())
def claim_belief(t):
    return rounded(combined(t))


@plan(belief_sql("perspective_id", "s", "s AS (SELECT d.*, perspective_id FROM d JOIN agents USING (agent_id)),"))
def scoped_belief(t):
    """Belief of each claim within each perspective's agents."""
    rows = masses(t).join(t.agents.select("agent_id", "perspective_id"), "agent_id")
    return rounded(combined(t, "perspective_id", rows=rows))


@plan(belief_sql(source="(SELECT * FROM d WHERE created_at <= TIMESTAMP '1998-06-30')"))
def belief_as_of(t):
    """Belief from the evidence up to a time."""
    return rounded(combined(t, rows=masses(t).where(F.col("created_at") <= F.lit("1998-06-30").cast("timestamp_ntz"))))


@plan(f"WITH {D_SQL} SELECT claim_id, agent_id, evidence_key, evidence_line, round(alpha, 6) AS alpha, round(m0, 6) AS m0, round(m1, 6) AS m1, round(th, 6) AS th FROM d")
def bba_discount(t):
    m = F.col("m")
    return masses(t).select("claim_id", "agent_id", "evidence_key", "evidence_line", R6("alpha").alias("alpha"), R6(m["m0"]).alias("m0"), R6(m["m1"]).alias("m1"), R6(m["th"]).alias("th"))


@plan(f"""SELECT claim_id, evidence_key, evidence_line, agent_id, round(CASE WHEN locality_tag LIKE 'intra%' THEN 1e-1 ELSE 1e0 END
   * CASE evidence_type WHEN 'testimonial' THEN 25e-2 ELSE {WEIGHT} END, 6) AS alpha FROM bba""")
def perspective_strength(t):
    """Reliability under a perspective's own weight for testimony and its own locality factor."""
    own = K.lookup({"testimonial": 0.25}, F.lower("evidence_type"))
    return t.bba.select("claim_id", "evidence_key", "evidence_line", "agent_id", R6(alpha(own, 0.1)).alias("alpha"))


PAIR_SQL = f"""{D_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY created_at, evidence_key, evidence_line, agent_id, m_sup, m_unsup) AS k FROM d),
p AS (SELECT claim_id, max(m0) FILTER (k = 1) AS a0, max(m1) FILTER (k = 1) AS a1, max(th) FILTER (k = 1) AS at_, max(m0) FILTER (k = 2) AS b0, max(m1) FILTER (k = 2) AS b1, max(th) FILTER (k = 2) AS bt FROM r WHERE k <= 2 GROUP BY 1 HAVING count(*) = 2),
q AS (SELECT claim_id, a0, a1, at_, b0, b1, bt, a0 * b1 + a1 * b0 AS k, a0 * b0 + a0 * bt + at_ * b0 AS c0, a1 * b1 + a1 * bt + at_ * b1 AS c1, at_ * bt AS ct FROM p)"""


def _pair_rule(name: str, step, m0: str, m1: str, th: str, cf: str, ms: str) -> None:
    cols = {"m0": m0, "m1": m1, "th": th, "cf": cf, "ms": ms}

    @plan(f"WITH {PAIR_SQL} SELECT claim_id, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in cols.items()) + " FROM q", name=name)
    def run(t):
        m = F.col("m")
        return pairs(t).select("claim_id", step(F.col("a"), F.col("b")).alias("m")).select("claim_id", *[R6(m[k]).alias(k) for k in cols])


_pair_rule("pair_conjunctive", E.conjunctive, "c0", "c1", "ct", "k", "0e0")
_pair_rule("pair_dempster", E.dempster, "c0 / (1 - k)", "c1 / (1 - k)", "ct / (1 - k)", "0e0", "0e0")
_pair_rule("pair_yager_closed", E.yager_closed, "c0", "c1", "ct + k", "0e0", "0e0")
_pair_rule("pair_dubois_prade", E.dubois_prade, "c0", "c1", "ct + a0 * b1 + a1 * b0", "0e0", "0e0")
_pair_rule("pair_yager_open", E.yager_open, "c0", "c1", "ct", "0e0", "k")
_pair_rule("pair_inagaki", lambda a, b: E.inagaki(a, b, 0.5), *[f"CASE WHEN k < 1e-9 THEN {c} ELSE {c} * (1 + 5e-1 * k / (1 - k)) END" for c in ("c0", "c1", "ct")], "CASE WHEN k < 1e-9 THEN k ELSE 0e0 END", "CASE WHEN k < 1e-9 THEN 0e0 ELSE 5e-1 * k END")
_pair_rule("pair_cautious", E.cautious, "least(a0 + at_, b0 + bt) - least(at_, bt)", "least(a1 + at_, b1 + bt) - least(at_, bt)", "least(at_, bt)",
           "greatest(1 - least(a0 + at_, b0 + bt) - least(a1 + at_, b1 + bt) + least(at_, bt), 0e0)", "0e0")


# two masses with conflict and missing parts of their own, on which every branch of the rules is reached
OPEN_SQL = f"""{PAIR_SQL}, o AS (SELECT claim_id, claim_id % 4 / 1e1 AS ua, claim_id % 3 / 1e1 AS ub, claim_id % 5 / 2e1 AS va, a0, a1, at_, b0, b1, bt FROM p),
w AS (SELECT claim_id, a0 * (1 - ua - va) AS a0, a1 * (1 - ua - va) AS a1, at_ * (1 - ua - va) AS at_, va AS ac, ua AS am, b0 * (1 - ub) AS b0, b1 * (1 - ub) AS b1, bt * (1 - ub) AS bt, 0e0 AS bc, ub AS bm FROM o),
c AS (SELECT claim_id, a0 * b0 + a0 * bt + at_ * b0 AS c0, a1 * b1 + a1 * bt + at_ * b1 AS c1, at_ * bt AS ct, am * bm AS cm, a0 * b1 + a1 * b0 + ac * (b0 + b1 + bt + bc + bm) + bc * (a0 + a1 + at_ + am) + am * (b0 + b1 + bt) + bm * (a0 + a1 + at_) AS k FROM w),
g AS (SELECT *, CASE claim_id % 6 WHEN 0 THEN 'conjunctive' WHEN 1 THEN 'dempster' WHEN 2 THEN 'yager_open' WHEN 3 THEN 'yager_closed' WHEN 4 THEN 'inagaki' ELSE 'none' END AS method, c0 + c1 + ct + cm AS rest FROM c)"""


@plan(f"""WITH {OPEN_SQL}, f AS (SELECT *, CASE method WHEN 'dempster' THEN 1 / (1 - k) WHEN 'inagaki' THEN CASE WHEN k < 1e-9 THEN 1 ELSE 1 + 5e-1 * k / rest END ELSE 1 END AS y FROM g WHERE method <> 'none')
SELECT claim_id, method, round(c0 * y, 6) AS m0, round(c1 * y, 6) AS m1, round(ct * y + CASE WHEN method = 'yager_closed' THEN k ELSE 0 END, 6) AS th,
 round(CASE WHEN method = 'conjunctive' OR method = 'inagaki' AND k < 1e-9 THEN k ELSE 0 END, 6) AS cf, round(cm * y + CASE WHEN method = 'yager_open' THEN k WHEN method = 'inagaki' AND k >= 1e-9 THEN 5e-1 * k ELSE 0 END, 6) AS ms FROM f""")
def redistributed(t):
    """Masses with conflict and missing parts combined by the rule that each claim names."""
    share = lambda n, by: (F.col("claim_id") % n) / by

    def opened(m, cf, ms):
        return E._bound(m, lambda m: E._bound(1 - cf - ms, lambda left: E.binary(m["m0"] * left, m["m1"] * left, m["th"] * left, cf, ms)))

    x = pairs(t).withColumns({"a": opened(F.col("a"), share(5, 20), share(4, 10)), "b": opened(F.col("b"), F.lit(0.0), share(3, 10))})
    method = F.element_at(F.array(*map(F.lit, ("conjunctive", "dempster", "yager_open", "yager_closed", "inagaki", "none"))), (F.col("claim_id") % 6 + 1).cast("int"))
    got = x.select("claim_id", method.alias("method"), E.redistribute(F.col("a"), F.col("b"), method).alias("m")).where("m IS NOT NULL")
    return got.select("claim_id", "method", *[R6(F.col("m")[k]).alias(k) for k in ("m0", "m1", "th", "cf", "ms")])


@plan(f"WITH {PAIR_SQL} SELECT claim_id, round(k, 6) AS k, CASE WHEN k < 1e-1 THEN 'dempster' WHEN k < 5e-1 THEN 'conjunctive' ELSE 'inagaki' END AS rule, CASE WHEN k < 3e-1 THEN 'dempster' ELSE 'conjunctive' END AS adaptive FROM q")
def pair_conflict_rule(t):
    k = E.conflict(F.col("a"), F.col("b"))
    return pairs(t).select("claim_id", R6(k).alias("k"), E.rule(k, F.col("a")["ms"]).alias("rule"), F.when(k < 0.3, "dempster").otherwise("conjunctive").alias("adaptive"))


@plan(f"""WITH {D_SQL}, q AS (SELECT claim_id, exp(sum(ln(m0 + th))) AS q0, exp(sum(ln(m1 + th))) AS q1, exp(sum(ln(th))) AS qt FROM d GROUP BY claim_id)
SELECT claim_id, round((q0 - qt) / (q0 + q1 - qt), 6) AS m0, round((q1 - qt) / (q0 + q1 - qt), 6) AS m1, round(qt / (q0 + q1 - qt), 6) AS th FROM q""")
def dempster_monoid(t):
    """The associative rule as an aggregate with partial sums."""
    m = F.col("x")
    got = masses(t).groupBy("claim_id").agg(C.dempster_binary(F.col("m.m0"), F.col("m.m1"), F.col("m.th")).alias("x"))
    return got.select("claim_id", *[R6(m[k]).alias(k) for k in ("m0", "m1", "th")])


@plan(f"WITH {D_SQL}, v AS (SELECT kind, max(m0) AS b, max(m0 + th) AS p FROM d JOIN claims USING (claim_id) GROUP BY kind) SELECT kind, round(b, 6) AS m0, round(greatest(1 - p, 0e0), 6) AS m1, round(p - b, 6) AS th FROM v")
def alternative_set_mass(t):
    """Claims of one kind as alternatives: the strongest belief and plausibility."""
    got = masses(t).join(t.claims.select("claim_id", "kind"), "claim_id").groupBy("kind").agg(C.alternative_set(F.col("m.m0"), F.col("m.m0") + F.col("m.th")).alias("x"))
    return got.select("kind", *[R6(F.col("x")[k]).alias(k) for k in ("m0", "m1", "th")])


TERNARY = """SELECT claim_id, evidence_key, evidence_line, agent_id,
  CASE WHEN evidence_line % 4 = 0 THEN 1 WHEN evidence_line % 4 = 1 THEN 2 WHEN evidence_line % 4 = 2 THEN 4 ELSE 3 END AS mask,
  evidence_line % 5 = 0 AS neg, greatest(m_sup, m_unsup) AS m FROM bba"""


@plan(f"""WITH e AS ({TERNARY}) SELECT claim_id, evidence_key, evidence_line, agent_id,
 round(CASE WHEN NOT neg AND mask & ~1 = 0 THEN m ELSE 0e0 END, 6) AS bel0, round(CASE WHEN NOT neg AND mask & 1 <> 0 THEN m ELSE 0e0 END + 1 - m, 6) AS pl0,
 round(CASE WHEN NOT neg AND mask & 3 = 3 THEN m ELSE 0e0 END + 1 - m, 6) AS q01,
 round((CASE WHEN NOT neg AND mask & 1 <> 0 THEN m / bit_count(mask) ELSE 0e0 END + (1 - m) / 3) / (1 - CASE WHEN neg THEN m ELSE 0e0 END), 6) AS betp0,
 CASE WHEN neg THEN 7 - mask ELSE mask END AS classical FROM e""")
def frame_measures(t):
    """Belief, plausibility, commonality and BetP on a frame of three hypotheses, with complements."""
    rows = t.sql(TERNARY).withColumn("x", F.array(E.element(F.col("mask"), F.col("neg"), F.col("m")), E.element(F.lit(7), F.lit(False), 1 - F.col("m"))))
    one, two = F.lit(1), F.lit(3)
    x = F.col("x")
    return rows.select("claim_id", "evidence_key", "evidence_line", "agent_id", R6(E.belief(x, one)).alias("bel0"), R6(E.plausibility(x, one)).alias("pl0"), R6(E.commonality(x, two)).alias("q01"), R6(E.pignistic(x, 0)).alias("betp0"), E.to_classical(x, 3)[0]["mask"].alias("classical"))


@plan("""WITH x AS (SELECT unnest(range(8)) AS mask, unnest([true, false]) AS z), s AS (SELECT CAST(mask AS INT) AS mask, neg FROM range(8) r(mask), (VALUES (true), (false)) n(neg))
SELECT a.mask AS a_mask, a.neg AS a_neg, b.mask AS b_mask, b.neg AS b_neg, CASE WHEN NOT a.neg AND NOT b.neg THEN a.mask & b.mask WHEN NOT a.neg THEN a.mask & (7 - b.mask) WHEN NOT b.neg THEN b.mask & (7 - a.mask) ELSE a.mask | b.mask END AS mask, a.neg AND b.neg AS neg FROM s a, s b""")
def focal_intersections(t):
    """All meetings of two focal elements of a frame of three hypotheses (256 rows whatever the data)."""
    one = t.spark.range(16).select((F.col("id") % 8).cast("int").alias("mask"), (F.col("id") >= 8).alias("neg"))
    both = one.select(F.struct("mask", "neg").alias("a")).crossJoin(one.select(F.struct("mask", "neg").alias("b")))
    got = E.intersect(F.col("a"), F.col("b"))
    return both.select(F.col("a.mask").alias("a_mask"), F.col("a.neg").alias("a_neg"), F.col("b.mask").alias("b_mask"), F.col("b.neg").alias("b_neg"), got["mask"].alias("mask"), got["neg"].alias("neg"))


@plan()
def combined_frame(t):
    """Adaptive combination on a frame of three hypotheses, by group."""
    rows = t.sql(TERNARY).select("claim_id", F.create_map(F.concat(F.when(F.col("neg"), "~").otherwise(""), K.lookup({1: "0", 2: "1", 4: "2", 3: "0,1"}, F.col("mask"))), F.col("m"), F.lit("0,1,2"), 1 - F.col("m")).alias("masses"), F.lit(0.9).alias("alpha"))
    got = C.combine_groups(rows, ["claim_id"], 3)
    x = C.as_elements(F.col("masses"))
    return got.select("claim_id", "n_sources", *[R6(E.pignistic(x, i)).alias(f"betp{i}") for i in range(3)], R6(E.belief(x, F.lit(1))).alias("bel0"), "error")


@plan("""SELECT l_partkey AS claim_id, l_orderkey, l_linenumber, l_suppkey, l_quantity, round(CASE WHEN t < 1e-12 THEN 0e0 ELSE a / t * s END, 6) AS m_for, round(CASE WHEN t < 1e-12 THEN 0e0 ELSE b / t * s END, 6) AS m_against, round(1 - s, 6) AS m_vacuous
FROM (SELECT *, a + b AS t, 1 - 2e0 / (a + b + 2) AS s FROM (SELECT *, l_quantity AS a, floor(l_discount * 100) AS b FROM lineitem) y) z""")
def beta_masses(t):
    x = E.beta_mass(F.col("l_quantity"), F.floor(F.col("l_discount") * 100).cast("double"))
    return t.lineitem.select(F.col("l_partkey").alias("claim_id"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", *[R6(x[k]).alias(k) for k in ("m_for", "m_against", "m_vacuous")])


METHODS = ("meta_analysis", "extraction", "statistical", "unheard_of")
METHOD_SQL = "CASE evidence_line % 4 WHEN 0 THEN 'meta_analysis' WHEN 1 THEN 'extraction' WHEN 2 THEN 'statistical' ELSE 'unheard_of' END"
SECTION_SQL = "CASE evidence_line % 3 WHEN 0 THEN 'results' WHEN 1 THEN 'introduction' ELSE 'unknown_section' END"


@plan(f"""WITH p AS (SELECT *, {METHOD_SQL} AS methodology, {SECTION_SQL} AS section, m_sup > 0 AS sup, greatest(m_sup, m_unsup) AS conf FROM bba),
c AS (SELECT *, CASE methodology WHEN 'meta_analysis' THEN 8e-1 WHEN 'extraction' THEN 58e-2 WHEN 'statistical' THEN 75e-2 ELSE 5e-1 END AS bs, CASE methodology WHEN 'extraction' THEN 7e-2 WHEN 'unheard_of' THEN 8e-2 ELSE 5e-2 END AS ba,
  CASE section WHEN 'introduction' THEN 5e-1 ELSE 1e0 END * 78e-2 AS kept, {WEIGHT} AS w FROM p),
s AS (SELECT *, least(bs * w * conf, 95e-2) AS s0, least(ba * (1 - conf * 5e-1), 3e-1) AS wk FROM c),
n AS (SELECT *, s0 * kept AS st, greatest(1 - s0 - wk, 0e0) + s0 * (1 - kept) AS th FROM s)
SELECT claim_id, agent_id, evidence_key, evidence_line, round(CASE WHEN sup THEN st ELSE wk END * 9e-1 / (st + wk + th), 6) AS m_sup, round(CASE WHEN sup THEN wk ELSE st END * 9e-1 / (st + wk + th), 6) AS m_unsup, round(th * 9e-1 / (st + wk + th), 6) AS m_theta, 1e-1 AS m_open FROM n""")
def directed_masses(t):
    """A mass function from methodology, section, journal and confidence."""
    rows = t.bba.withColumns({"method": F.expr(METHOD_SQL), "section": F.expr(SECTION_SQL)})
    profile = K.methodology(F.col("method"))
    kept = F.coalesce(K.lookup(K.SECTION_WEIGHT, F.col("section")), F.lit(1.0)) * 0.78
    x = E.directed_mass(F.col("m_sup") > 0, profile["support"], profile["against"], F.coalesce(K.evidence_weight(F.col("evidence_type")), F.lit(0.5)), F.greatest("m_sup", "m_unsup"), kept, 0.1)
    return rows.select("claim_id", "agent_id", "evidence_key", "evidence_line", *[R6(v).alias(k) for k, v in x.items()])


@plan(f"""WITH b AS ({belief_sql()}) SELECT claim_id, array_to_string(list_filter([CASE WHEN 1 - betp <= 414726e-6 THEN 'supported' END, CASE WHEN 1 - betp_unsup <= 36756e-5 THEN 'contradicted' END, CASE WHEN 1 - theta <= 117009e-6 THEN 'not_enough_info' END], lambda x: x IS NOT NULL), ',') AS classes FROM b""")
def conformal_sets(t):
    """All classes that the calibrated quantiles allow."""
    b = rounded(combined(t))
    return b.select("claim_id", F.array_join(E.conformal(F.col("betp"), F.col("betp_unsup"), F.col("theta"), K.QUANTILES), ",").alias("classes"))


@plan("""SELECT p_partkey AS claim_id, round(e / t, 6) AS precision_ratio, round(1 - exp(-5e-1 * (e / t) * (e / t)), 6) AS strength, round(sy * sy / (t * t), 6) AS systematic_fraction, round(least(sc, 3e-1), 6) AS m_open,
round((1 - least(sc, 3e-1)) * (1 - exp(-5e-1 * (e / t) * (e / t))) * (1 - sy * sy / (t * t)), 6) AS m_evidence, round((1 - least(sc, 3e-1)) * ((1 - exp(-5e-1 * (e / t) * (e / t))) * sy * sy / (t * t) + exp(-5e-1 * (e / t) * (e / t))), 6) AS m_theta
FROM (SELECT p_partkey, p_size / 1e1 AS e, p_size % 4 / 2e0 AS sy, (p_size % 5) / 1e1 AS sc, greatest(sqrt((p_size % 7) / 2e0 * ((p_size % 7) / 2e0) + p_size % 4 / 2e0 * (p_size % 4 / 2e0)), 1e-10) AS t FROM part) z""")
def error_budgets(t):
    s = F.col("p_size")
    x = E.error_mass(s / 10, (s % 7) / 2, (s % 4) / 2, (s % 5) / 10)
    return t.part.select(F.col("p_partkey").alias("claim_id"), *[R6(v).alias(k) for k, v in x.items()])


TEXTS = """SELECT p_partkey AS claim_id, CASE p_size % 7 WHEN 0 THEN concat('gain of ±', p_size, '.5 %') WHEN 1 THEN concat('value (', p_size, ' ± 1.5)') WHEN 2 THEN concat(p_size, ' ± 0.2 units')
 WHEN 3 THEN concat('95% CI [', p_size, ', ', p_size + 2, ']') WHEN 4 THEN 'p < 0.01' WHEN 5 THEN concat('P = 0.', p_size) ELSE 'no number given' END AS body FROM part"""


@plan(f"""WITH x AS ({TEXTS}), n AS (SELECT p_partkey, p_size AS s FROM part) SELECT claim_id, round(CASE s % 7 WHEN 0 THEN least(greatest((s + 5e-1) / 100, 1e-2), 99e-2) WHEN 1 THEN least(15e-1 / s, 99e-2) WHEN 2 THEN least(greatest(2e-1 / s, 1e-2), 99e-2)
 WHEN 3 THEN least(2e0 / (s + 1), 99e-2) WHEN 4 THEN 1e-1 WHEN 5 THEN CASE WHEN CAST(concat('0.', s) AS DOUBLE) <= 1e-3 THEN 5e-2 WHEN CAST(concat('0.', s) AS DOUBLE) <= 1e-2 THEN 1e-1 WHEN CAST(concat('0.', s) AS DOUBLE) <= 5e-2 THEN 2e-1 ELSE least(4e-1 + CAST(concat('0.', s) AS DOUBLE), 99e-2) END END, 6) AS uncertainty FROM x JOIN n ON claim_id = p_partkey""")
def text_uncertainty(t):
    return t.sql(TEXTS).select("claim_id", R6(E.uncertainty(F.col("body"))).alias("uncertainty"))


@plan("""WITH l AS (SELECT claim_id, list(struct_pack(p := source_strength, s := m_sup > 0) ORDER BY created_at, evidence_key, evidence_line, agent_id, m_sup, m_unsup, source_strength) AS xs FROM bba GROUP BY 1)
SELECT claim_id, round(list_reduce(list_prepend(struct_pack(p := 5e-1, s := true), xs), lambda a, x: struct_pack(p := least(greatest(
 CASE WHEN x.s THEN (5e-1 + 5e-1 * x.p) * a.p / ((5e-1 + 5e-1 * x.p) * a.p + (5e-1 - 4e-1 * x.p) * (1 - a.p)) ELSE (5e-1 - 4e-1 * x.p) * a.p / ((5e-1 - 4e-1 * x.p) * a.p + (5e-1 + 5e-1 * x.p) * (1 - a.p)) END, 1e-2), 99e-2), s := true)).p, 6) AS truth FROM l""")
def bayesian_fold(t):
    """Truth after each claim's evidence in order of time."""
    order = F.struct("created_at", "evidence_key", "evidence_line", "agent_id", "m_sup", "m_unsup", "source_strength")
    ordered = t.bba.groupBy("claim_id").agg(F.array_sort(F.collect_list(order)).alias("xs"))
    return ordered.select("claim_id", R6(F.aggregate("xs", F.lit(0.5), lambda p, x: E.bayes_step(p, x["source_strength"], x["m_sup"] > 0))).alias("truth"))


@plan("""WITH w AS (SELECT claim_id, list(least(greatest(CASE evidence_type WHEN 'empirical' THEN 1e0 ELSE 6e-1 END * source_strength * pow(99e-2, date_diff('day', CAST(created_at AS DATE), DATE '2001-12-31')), 1e-2), 1e0) ORDER BY 1) AS xs, count(*) AS n FROM bba GROUP BY 1),
r AS (SELECT claim_id, n, least(list_sum(list_transform(list_reverse_sort(xs), lambda x, i: x * pow(5e-1, i - 1))) / 2, 1e0) AS w FROM w)
SELECT claim_id, n AS pieces, round(w, 6) AS weight, round(least(5e-1 + 5e-1 * w + CASE n WHEN 0 THEN 0e0 WHEN 1 THEN 1e-1 WHEN 2 THEN 15e-2 WHEN 3 THEN 18e-2 ELSE 2e-1 END, 85e-2), 6) AS initial_truth FROM r""")
def evidence_weights(t):
    """Weights by type, relevance and age; combined, and the truth to start from."""
    age = F.datediff(F.lit("2001-12-31").cast("date"), F.col("created_at").cast("date"))
    weight = F.greatest(F.least(K.evidence_weight(F.col("evidence_type")) * F.col("source_strength") * F.pow(F.lit(0.99), age), F.lit(1.0)), F.lit(0.01))
    got = t.bba.groupBy("claim_id").agg(F.collect_list(weight).alias("xs"), F.count("*").alias("pieces")).withColumn("w", E.combined_weight(F.col("xs")))
    return got.select("claim_id", "pieces", R6("w").alias("weight"), R6(E.initial_truth(F.col("w"), F.col("pieces"))).alias("initial_truth"))


@plan(f"""WITH b AS ({belief_sql()}), j AS (SELECT claim_id, least(greatest(betp, 1e-10), 1 - 1e-10) AS p, least(greatest(truth_value, 1e-10), 1 - 1e-10) AS q FROM b JOIN claims USING (claim_id))
SELECT claim_id, round(p * ln(p / q) + (1 - p) * ln((1 - p) / (1 - q)), 6) AS kl FROM j""")
def belief_divergence(t):
    """Divergence of the pignistic probability from the truth value."""
    return rounded(combined(t)).join(t.claims, "claim_id").select("claim_id", R6(E.bernoulli_kl(F.col("betp"), F.col("truth_value"))).alias("kl"))


@plan(f"""WITH b AS ({belief_sql()}), e AS (SELECT source_id, target_id, source_key, relationship, strength, belief AS bel, plausibility AS pl, missing AS ow,
  CASE relationship WHEN 'supports' THEN 8e-1 WHEN 'elaborates' THEN 6e-1 ELSE -9e-1 END AS f FROM edges JOIN b ON source_id = claim_id WHERE NOT (plausibility - belief >= 999e-3 AND belief < 1e-2)),
r AS (SELECT *, CASE WHEN f > 0 THEN bel * f ELSE (1 - pl) * -f END AS rb, CASE WHEN f > 0 THEN 1 - (1 - pl) * f ELSE 1 - bel * -f END AS rp FROM e)
SELECT source_id, target_id, source_key, relationship, strength, round(rb + 1e-9, 6) AS m0, round(1 - rp + 1e-9, 6) AS m1, round(greatest(rp - rb - least(ow, rp - rb), 0e0) + 1e-9, 6) AS th, round(least(ow, rp - rb) + 1e-9, 6) AS ms FROM r""")
def edge_masses(t):
    """The mass that each edge passes on from its source's interval."""
    b = rounded(combined(t)).select(F.col("claim_id").alias("source_id"), "belief", "plausibility", "missing")
    e = t.edges.join(b, "source_id").where(~((F.col("plausibility") - F.col("belief") >= 0.999) & (F.col("belief") < 0.01)))
    low, high = E.restrict(F.col("belief"), F.col("plausibility"), K.restriction(F.col("relationship")))
    m = E.interval_mass(low, high, F.col("missing"))
    return e.select("source_id", "target_id", "source_key", "relationship", "strength", *[R6(m[k] + TIE).alias(k) for k in ("m0", "m1", "th", "ms")])


@plan("""SELECT claim_id, agent_id, evidence_key, evidence_line, round(m_sup * f, 6) AS m0, round(m_unsup * f, 6) AS m1 FROM (SELECT *, greatest(least(1 - date_diff('day', CAST(created_at AS DATE), DATE '2001-12-31') / 2e3, 1e0), 0e0) AS f FROM bba) z""")
def temporal_decay(t):
    """A context that discounts masses by age within a window of days."""
    age = F.datediff(F.lit("2001-12-31").cast("date"), F.col("created_at").cast("date"))
    f = F.greatest(F.least(1 - age / 2000.0, F.lit(1.0)), F.lit(0.0))
    return t.bba.select("claim_id", "agent_id", "evidence_key", "evidence_line", R6(F.col("m_sup") * f).alias("m0"), R6(F.col("m_unsup") * f).alias("m1"))


@plan(f"""WITH b AS ({belief_sql()}) SELECT claim_id, belief, plausibility FROM b WHERE belief >= 2e-1 AND plausibility <= 9e-1""")
def belief_interval_filter(t):
    return rounded(combined(t)).where("belief >= 0.2 AND plausibility <= 0.9").select("claim_id", "belief", "plausibility")


@plan(f"""WITH h AS (SELECT DISTINCT claim_id FROM bba WHERE created_at >= TIMESTAMP '2001-10-20'), {belief_sql(source='(SELECT d.* FROM d WHERE claim_id IN (SELECT claim_id FROM h))')[5:]}""")
def refreshed_beliefs(t):
    """Recomputation of the claims that new evidence or a retraction touches, and no others."""
    hit = t.bba.where(F.col("created_at") >= F.lit("2001-10-20").cast("timestamp_ntz")).select("claim_id").distinct()
    return rounded(combined(t, rows=masses(t).join(hit, "claim_id", "left_semi")))


@plan("""SELECT l_partkey AS claim_id, round(max(greatest(least(CASE l_returnflag WHEN 'R' THEN 0e0 ELSE 6e-1 * l_quantity / 5e1 END, 1e0), 0e0)), 6) AS belief, CASE WHEN max(CASE l_returnflag WHEN 'R' THEN 0e0 ELSE 6e-1 * l_quantity / 5e1 END) >= 6e-1 THEN 'ready' ELSE 'insufficient_belief' END AS verdict FROM lineitem GROUP BY 1""")
def promotion_gate(t):
    """Hypotheses with enough belief to be promoted."""
    x = F.when(F.col("l_returnflag") == "R", 0.0).otherwise(0.6 * F.col("l_quantity") / 50)
    got = t.lineitem.groupBy(F.col("l_partkey").alias("claim_id")).agg(F.max(E.unit(x)).alias("b"))
    return got.select("claim_id", R6("b").alias("belief"), F.when(F.col("b") >= K.PROMOTION, "ready").otherwise("insufficient_belief").alias("verdict"))


#: A claim belongs to the frames of its size's region.
FRAMED = "SELECT claim_id, n_nationkey AS perspective_id FROM claims JOIN nation ON n_regionkey = size % 5"


@plan(f"""WITH s AS ({belief_sql("perspective_id", "s", "s AS (SELECT d.*, perspective_id FROM d JOIN agents USING (agent_id)),")}), f AS ({FRAMED})
SELECT f.claim_id, f.perspective_id, coalesce(n_sources, 0) AS n_sources, coalesce(belief, 0e0) AS belief, coalesce(plausibility, 1e0) AS plausibility, coalesce(betp, 5e-1) AS betp, coalesce(classification, 'not_enough_info') AS classification FROM f LEFT JOIN s ON s.claim_id = f.claim_id AND s.perspective_id = f.perspective_id""")
def framed_belief(t):
    """Belief of each claim in each frame that it is assigned to; without masses there it is vacuous."""
    rows = masses(t).join(t.agents.select("agent_id", "perspective_id"), "agent_id")
    got = t.sql(FRAMED).join(rounded(combined(t, "perspective_id", rows=rows)), ["claim_id", "perspective_id"], "left")
    none = {"n_sources": F.lit(0), "belief": F.lit(0.0), "plausibility": F.lit(1.0), "betp": F.lit(0.5), "classification": F.lit("not_enough_info")}
    return got.select("claim_id", "perspective_id", *[F.coalesce(F.col(k), v).alias(k) for k, v in none.items()])


LATE = "2001-10-20"


@plan(f"""WITH n AS (SELECT DISTINCT claim_id FROM bba WHERE created_at >= TIMESTAMP '{LATE}'), o AS ({belief_sql(source=f"(SELECT d.* FROM d WHERE created_at < TIMESTAMP '{LATE}' AND claim_id IN (SELECT claim_id FROM n))")}), x AS ({belief_sql(source="(SELECT d.* FROM d WHERE claim_id IN (SELECT claim_id FROM n))")})
SELECT n.claim_id, coalesce(o.n_sources, 0) AS sources_before, x.n_sources AS sources_after, coalesce(o.belief, 0e0) AS belief_before, x.belief AS belief_after, coalesce(o.plausibility, 1e0) AS plausibility_before, x.plausibility AS plausibility_after, x.conflict FROM n JOIN x ON x.claim_id = n.claim_id LEFT JOIN o ON o.claim_id = n.claim_id""")
def submitted_evidence(t):
    """A batch of new evidence: discounted, stored beside the old, and the belief of the claims it touches before and after."""
    late = F.lit(LATE).cast("timestamp_ntz")
    hit = t.bba.where(F.col("created_at") >= late).select("claim_id").distinct()
    rows = masses(t).join(hit, "claim_id", "left_semi")
    before = rounded(combined(t, rows=rows.where(F.col("created_at") < late))).select("claim_id", F.col("n_sources").alias("sources_before"), F.col("belief").alias("belief_before"), F.col("plausibility").alias("plausibility_before"))
    after = rounded(combined(t, rows=rows)).select("claim_id", F.col("n_sources").alias("sources_after"), F.col("belief").alias("belief_after"), F.col("plausibility").alias("plausibility_after"), "conflict")
    return after.join(before, "claim_id", "left").fillna({"sources_before": 0, "belief_before": 0.0, "plausibility_before": 1.0})


@plan(f"""WITH e AS (SELECT *, CASE WHEN created_at < TIMESTAMP '1995-01-01' THEN 'expired' WHEN evidence_type = 'testimonial' THEN 'discounted' ELSE 'kept' END AS context FROM bba)
SELECT claim_id, evidence_key, evidence_line, agent_id, context, round(CASE context WHEN 'expired' THEN 0 WHEN 'discounted' THEN 7e-1 ELSE 1 END * m_sup, 6) AS m0, round(CASE context WHEN 'expired' THEN 0 WHEN 'discounted' THEN 7e-1 ELSE 1 END * m_unsup, 6) AS m1,
 round(1 - CASE context WHEN 'expired' THEN 0 WHEN 'discounted' THEN 7e-1 ELSE 1 END * (m_sup + m_unsup), 6) AS th FROM e""")
def context_masses(t):
    """Contexts of a frame: what falls outside one is vacuous, a discount moves mass to the frame."""
    context = F.when(F.col("created_at") < F.lit("1995-01-01").cast("timestamp_ntz"), "expired").when(F.col("evidence_type") == "testimonial", "discounted").otherwise("kept")
    x = masses(t).withColumn("context", context)
    kept = K.lookup({"expired": 0.0, "discounted": 0.7, "kept": 1.0}, F.col("context"))
    m = E.discount(F.col("raw"), kept)
    return x.select("claim_id", "evidence_key", "evidence_line", "agent_id", "context", *[R6(m[k]).alias(k) for k in ("m0", "m1", "th")])
