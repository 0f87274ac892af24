"""Calibration tables as literal columns.

Fixed values: they must equal those that the calibrated classifier was fitted with.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Methodology -> support, against, ignorance.
METHODOLOGY = {
    "legal_document_review": (0.90, 0.02, 0.08), "deductive_logic": (0.85, 0.05, 0.10), "meta_analysis": (0.80, 0.05, 0.15),
    "theoretical_derivation": (0.80, 0.05, 0.15), "statistical_analysis": (0.75, 0.05, 0.20), "bayesian_inference": (0.70, 0.05, 0.25),
    "computational": (0.72, 0.05, 0.23), "instrumental": (0.80, 0.05, 0.15), "inductive_generalization": (0.60, 0.08, 0.32),
    "visual_inspection": (0.55, 0.08, 0.37), "observational": (0.60, 0.08, 0.32), "expert_elicitation": (0.45, 0.10, 0.45),
    "extraction": (0.58, 0.07, 0.35), "textbook_assertion": (0.78, 0.04, 0.18), "negative_result": (0.70, 0.05, 0.25), "default": (0.50, 0.08, 0.42),
}
METHODOLOGY_ALIAS = {
    "deductive": "deductive_logic", "deductive_reasoning": "deductive_logic", "meta-analysis": "meta_analysis", "statistical": "statistical_analysis",
    "statistical_inference": "statistical_analysis", "bayesian": "bayesian_inference", "computational_simulation": "computational",
    "instrumental_measurement": "instrumental", "experimental_observation": "instrumental", "inductive": "inductive_generalization",
    "expert": "expert_elicitation", "testimonial": "expert_elicitation", "llm_extraction": "extraction", "literature_synthesis": "extraction",
}
EVIDENCE_WEIGHT = {
    "regulatory": 1.0, "empirical": 1.0, "statistical": 0.9, "logical": 0.85, "testimonial": 0.6, "circumstantial": 0.4, "conversational": 0.3,
    "derived_support": 0.7, "derived_refute": 0.7, "derived_supersession": 0.7, "derived_elaboration": 0.65, "derived_generalization": 0.5,
    "derived_informational": 0.5, "derived_frame_evidence": 0.7,
}
EVIDENCE_ALIAS = {
    "observation": "empirical", "computation": "statistical", "document": "logical", "reference": "logical", "testimony": "testimonial",
    "supports": "derived_support", "corroborates": "derived_support", "refutes": "derived_refute", "contradicts": "derived_refute",
    "supersedes": "derived_supersession", "elaborates": "derived_elaboration", "specializes": "derived_elaboration",
    "generalizes": "derived_generalization", "informs": "derived_informational", "frame_validates": "derived_frame_evidence",
}
SECTION_WEIGHT = {"primary_provision": 1.0, "results": 1.0, "methods": 0.90, "discussion": 0.70, "conclusion": 0.65, "introduction": 0.50, "abstract": 0.80, "other": 0.75}
NEI, SUPPORT, CONFLICT, OPPOSING = 0.85, 0.15, 0.05, 0.1
QUANTILES = {"supported": 0.414726, "contradicted": 0.367560, "not_enough_info": 0.117009}
INTRA_LOCALITY, UNKNOWN_WEIGHT = 0.3, 0.5
# Relationship -> sign and factor of the restriction, by profile.
RESTRICTION = {
    "scientific": {"supports": 0.80, "elaborates": 0.60, "generalizes": 0.50, "refutes": 0.80, "contradicts": 0.90, "informs": 0.30},
    "regulatory": {"supports": 0.95, "elaborates": 0.85, "generalizes": 0.70, "refutes": 0.95, "contradicts": 0.97, "informs": 0.40},
}
RESTRICTION_OF = {
    "supports": (1, "supports"), "corroborates": (1, "supports"), "elaborates": (1, "elaborates"), "specializes": (1, "elaborates"), "generalizes": (1, "generalizes"),
    "refutes": (-1, "refutes"), "contradicts": (-1, "contradicts"), "supersedes": (-1, "contradicts"), "informs": (1, "informs"),
}
# Relationship -> factor, forward and reverse strength.
FACTOR = {
    "CORROBORATES": ("evidential_support", 0.85, 0.85), "same_as": ("evidential_support", 0.95, 0.95), "equivalent_to": ("evidential_support", 0.95, 0.95),
    "evidential_support": ("evidential_support", 0.8, 0.8), "variant_of": ("evidential_support", 0.65, 0.65), "definitional_variant_of": ("evidential_support", 0.9, 0.9),
    "analogous": ("evidential_support", 0.2, 0.2), "CONTRADICTS": ("mutual_exclusion", 0.0, 0.0), "contradicts": ("mutual_exclusion", 0.0, 0.0),
    "REFUTES": ("mutual_exclusion", 0.0, 0.0), "challenges": ("mutual_exclusion", 0.0, 0.0), "decomposes_to": ("directional_support", 0.0, 0.6),
    "supports": ("directional_support", 0.7, 0.15), "SUPPORTS": ("directional_support", 0.7, 0.15), "provides_evidence": ("directional_support", 0.7, 0.15),
    "refines": ("directional_support", 0.6, 0.2), "derived_from": ("directional_support", 0.5, 0.15), "derives_from": ("directional_support", 0.5, 0.15),
    "DERIVED_FROM": ("directional_support", 0.0, 0.6), "specializes": ("directional_support", 0.55, 0.15),
    "enables": ("directional_support", 0.3, 0.6), "has_method_capability": ("directional_support", 0.6, 0.4), "INFORMS": ("directional_support", 0.4, 0.1),
}


def lookup(table: dict, key: Column) -> Column:
    """``table[key]``, null where there is none."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))[key]


def evidence_weight(kind: Column) -> Column:
    """Weight of an evidence type or alias (any case); null where it is unknown."""
    kind = F.lower(kind)
    return lookup(EVIDENCE_WEIGHT, F.coalesce(lookup(EVIDENCE_ALIAS, kind), kind))


def methodology(name: Column) -> Column:
    """Support and against of a methodology, by alias or name, else the default."""
    parts = {k: i for i, k in enumerate(METHODOLOGY)}
    at = F.coalesce(lookup(parts, F.coalesce(lookup(METHODOLOGY_ALIAS, name), name)), F.lit(parts["default"]))
    rows = F.array(*[F.struct(F.lit(s).alias("support"), F.lit(a).alias("against")) for s, a, _ in METHODOLOGY.values()])
    return rows[at]


def restriction(relationship: Column, profile: str = "scientific") -> Column:
    """Signed factor of a relationship (any case): above 0 keeps, below 0 flips, null is neutral."""
    values = {k: s * RESTRICTION[profile][f] for k, (s, f) in RESTRICTION_OF.items()}
    return lookup(values, F.lower(relationship))

# Fixed value: the belief from which a hypothesis may be promoted.
PROMOTION = 0.60
