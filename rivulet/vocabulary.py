"""Word lists and limits of the engine.

Lists marked "fixed values" are part of the query semantics and are stated as
they are.  The domain dictionary is a parameter of every operator that uses it
(``Domains``); the default below is a small one of this library's own choice.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

# Link predicates by how properties pass through them.
TRANSPARENT_LINKS = ["is_a", "subclass_of", "instance_of", "is_type_of", "type_of", "kind_of", "classified_as", "is_mostly"]
OPAQUE_LINKS = [
    "uses", "employs", "utilizes", "relies_on", "causes", "caused_by", "leads_to", "results_in", "enables", "prevents", "blocks",
    "created_by", "invented_by", "built_by", "symbolizes", "represents", "associated_with", "located_in", "found_in", "part_of",
    "produces", "generates", "outputs", "preceded_by", "followed_by", "similar_to", "analogous_to", "compares", "says", "proposed",
    "absorbs", "regulates", "converts", "predecessor_of", "successor_of",
]
SEMI_TRANSPARENT_LINKS = ["has_part", "contains", "includes", "made_of", "composed_of"]
# Inherited predicates by kind.
INTRINSIC = [
    "has_formula", "boils_at", "freezes_at", "melts_at", "has_state", "has_density", "has_mass", "has_weight", "has_color", "has_ph",
    "has_temperature", "has_property", "has_depth", "has_height", "has_length", "has_width", "covers", "has_population", "has_area",
    "weighs", "measures", "costs", "tastes_like", "smells_like", "looks_like", "has_wavelength", "has_frequency",
]
RELATIONAL = ["is_a", "subclass_of", "essential_for", "used_for", "enables", "prevents", "causes", "caused_by", "found_in", "located_in", "related_to", "connected_to"]
IDENTITY = ["has_formula", "is_a", "defined_as", "has_part", "part_of", "made_of"]

# Predicates that the inference rules skip, and the taxonomy links.
TRANSITIVE_SKIP = ["structurally_similar_to", "commonly_confused_with", "analogous_to", "inspired_by"]
CROSS_SKIP = ["is_a", "structurally_similar_to", "commonly_confused_with"]
ANALOGY_SKIP = ["structurally_similar_to", "commonly_confused_with", "analogous_to"]
TAXONOMY_LINKS = ["is_a", "subclass_of", "is_type_of", "instance_of"]
# Predicates that the offline verifier accepts (curriculum and production runs).
SAFE_CURRICULUM = ["is_a", "uses", "has_part", "has_component", "needs", "made_of", "contains", "lives_in", "eats", "produces", "enables", "requires", "causes"]
SAFE_PRODUCTION = ["is_a", "uses", "has_component", "enables", "requires", "outputs", "processes"]

# Canonical predicate and its variants; a variant listed twice goes to the later one.
PREDICATE_VARIANTS = {
    "is_a": ["is_type_of", "is_kind_of", "type_of", "kind_of", "instance_of", "is_instance_of", "classified_as", "is_classified_as", "belongs_to_category"],
    "subclass_of": ["subcategory_of", "is_subclass_of", "sub_type_of", "specialization_of", "narrower_than"],
    "has_part": ["has_component", "contains_part", "includes", "comprises", "consists_of_part"],
    "part_of": ["component_of", "is_part_of", "belongs_to", "contained_in", "member_of"],
    "uses": ["utilizes", "employs", "makes_use_of", "uses_tool", "uses_technique", "relies_on", "depends_on"],
    "used_for": ["utilized_for", "employed_for", "serves_as", "functions_as", "purpose_is"],
    "created_by": ["made_by", "built_by", "developed_by", "designed_by", "invented_by", "authored_by", "constructed_by"],
    "produces": ["generates", "outputs", "creates", "yields", "results_in", "gives"],
    "causes": ["leads_to", "results_in", "triggers", "induces", "brings_about", "gives_rise_to"],
    "caused_by": ["due_to", "result_of", "caused_from", "originates_from", "stems_from"],
    "prevents": ["blocks", "stops", "inhibits", "suppresses"],
    "enables": ["allows", "permits", "makes_possible", "facilitates", "supports"],
    "has_property": ["has_quality", "has_attribute", "has_characteristic", "characterized_by", "described_as"],
    "made_of": ["composed_of", "consists_of", "material_is", "constructed_from", "built_from"],
    "located_in": ["found_in", "situated_in", "exists_in", "occurs_in", "present_in", "lives_in"],
    "similar_to": ["resembles", "like", "comparable_to", "analogous_to", "akin_to"],
    "different_from": ["distinct_from", "unlike", "contrasts_with", "differs_from", "not_same_as"],
    "larger_than": ["bigger_than", "greater_than", "exceeds", "more_than"],
    "smaller_than": ["less_than", "tinier_than", "under"],
    "requires": ["needs", "depends_on", "must_have", "prerequisite_is", "demands"],
    "defined_as": ["means", "definition_is", "refers_to", "known_as", "described_as"],
    "preceded_by": ["comes_after", "follows", "succeeded"],
    "followed_by": ["comes_before", "precedes", "leads_into"],
}

# Manual synonyms of the search index.
MANUAL_SYNONYMS = {
    "hot": ["temperature", "heat", "thermal"],
    "cold": ["temperature", "freeze", "ice"],
    "big": ["large", "huge", "enormous", "giant"],
    "small": ["tiny", "little", "miniature"],
    "fast": ["quick", "rapid", "speed"],
    "slow": ["sluggish", "gradual"],
    "water": ["h2o", "liquid", "moisture"],
    "light": ["photon", "electromagnetic_radiation", "illumination"],
    "sound": ["audio", "acoustic", "noise", "vibration"],
    "earth": ["planet", "world", "globe"],
    "brain": ["mind", "cerebral", "neural", "cognitive"],
    "computer": ["machine", "processor", "computing"],
    "alive": ["living", "biological", "organism"],
    "dead": ["deceased", "non_living", "extinct"],
}

# Bridge types, discovery predicates and structural keywords.
BRIDGE_TYPES = [
    "historical", "inspirational", "structural", "metaphorical", "emergent", "causal", "cultural", "etymological", "scale", "pedagogical",
    "contradictory", "experiential", "spiritual", "religious", "ethical", "aesthetic", "rumor", "mythological", "linguistic",
    "technological", "emotional", "pattern", "philosophical", "sensory", "humor",
]
BRIDGE_PREDICATES = [
    "inspired_by", "modeled_after", "analogous_to", "borrows_from", "similar_mechanism_to", "same_equation_as", "isomorphic_to",
    "led_to_discovery_of", "enabled", "structurally_similar_to", "behaves_like",
]
NOISE_PREDICATES = ["is_a", "has", "has_part", "has_property", "related_to", "similar_to"]
STRUCTURAL_WORDS = [
    "branching", "oscillation", "feedback_loop", "equilibrium", "gradient", "diffusion", "resonance", "phase_transition", "entropy",
    "exponential_growth", "network_effects", "self_organization", "emergence", "conservation", "symmetry", "recursion",
]

# Stop words of the question parser.
STOP_WORDS = [
    "what", "how", "why", "does", "is", "are", "the", "a", "an", "in", "of", "to", "and", "or", "can", "do", "this", "that", "it", "for",
    "with", "from", "about", "between", "be", "was", "were", "will", "would", "could", "should", "not", "but",
]

# Relations of the two public dumps.
CONCEPTNET_RELATIONS = {
    "/r/IsA": "is_a", "/r/PartOf": "part_of", "/r/HasA": "has", "/r/UsedFor": "used_for", "/r/CapableOf": "can", "/r/AtLocation": "found_at",
    "/r/Causes": "causes", "/r/HasProperty": "has_property", "/r/MadeOf": "made_of", "/r/ReceivesAction": "receives_action",
    "/r/CreatedBy": "created_by", "/r/DefinedAs": "defined_as", "/r/HasPrerequisite": "requires", "/r/HasSubevent": "involves",
    "/r/HasFirstSubevent": "starts_with", "/r/HasLastSubevent": "ends_with", "/r/MotivatedByGoal": "motivated_by",
    "/r/CausesDesire": "causes_desire_for", "/r/Desires": "desires", "/r/SymbolOf": "symbolizes", "/r/LocatedNear": "near",
    "/r/SimilarTo": "similar_to", "/r/Antonym": "opposite_of", "/r/DerivedFrom": "derived_from", "/r/RelatedTo": "related_to",
}
WIKIDATA_PROPERTIES = {
    "P31": "is_a", "P279": "subclass_of", "P361": "part_of", "P527": "has_part", "P1552": "has_quality", "P186": "made_of", "P176": "made_by",
    "P17": "located_in_country", "P131": "located_in", "P36": "has_capital", "P30": "located_on_continent", "P1376": "capital_of",
    "P37": "official_language", "P47": "shares_border_with", "P138": "named_after", "P61": "discovered_by", "P170": "created_by",
    "P178": "developed_by", "P1071": "location_of_creation", "P127": "owned_by", "P155": "preceded_by", "P156": "followed_by",
    "P366": "used_for", "P1542": "causes", "P1478": "has_immediate_cause", "P828": "has_cause", "P2283": "uses", "P101": "field_of_work",
    "P106": "occupation", "P39": "position_held", "P108": "employer", "P69": "educated_at", "P800": "notable_work", "P135": "movement",
    "P136": "genre", "P495": "country_of_origin", "P6": "head_of_government", "P35": "head_of_state",
}

# Typed predicates (domains allowed for subject and object; '*' is any) and pairs of domains that never meet.
TYPED_PREDICATES = {
    "eats": (["biology", "everyday"], ["biology", "everyday"]),
    "lives_in": (["biology", "everyday"], ["geography", "everyday", "earth_science"]),
    "breathes": (["biology", "everyday"], ["chemistry", "biology"]),
    "reproduces_via": (["biology"], ["biology"]),
    "has_organ": (["biology"], ["biology"]),
    "migrates_to": (["biology"], ["geography"]),
    "has_capital": (["geography"], ["geography"]),
    "borders": (["geography"], ["geography"]),
    "has_population": (["geography"], ["mathematics", "geography"]),
    "elected_in": (["history", "geography"], ["history"]),
    "governed_by": (["geography", "history"], ["history", "geography"]),
    "reacts_with": (["chemistry"], ["chemistry"]),
    "dissolves_in": (["chemistry"], ["chemistry"]),
    "has_ph": (["chemistry"], ["chemistry", "mathematics"]),
    "oxidizes": (["chemistry"], ["chemistry"]),
    "orbits": (["physics", "earth_science"], ["physics", "earth_science"]),
    "has_wavelength": (["physics"], ["physics", "mathematics"]),
    "has_mass": (["physics", "chemistry", "everyday"], ["physics", "mathematics"]),
    "trains_via": (["computer_science"], ["computer_science", "mathematics"]),
    "compiles_to": (["computer_science"], ["computer_science"]),
    "runs_on": (["computer_science"], ["computer_science"]),
    "has_complexity": (["computer_science", "mathematics"], ["computer_science", "mathematics"]),
    "tokenizes": (["computer_science"], ["computer_science"]),
    "tastes_like": (["everyday", "biology"], ["everyday"]),
    "smells_like": (["everyday", "biology"], ["everyday"]),
    "sounds_like": (["everyday", "physics"], ["everyday"]),
    "discovered_by": (["*"], ["history"]),
}
HARD_BLOCKS = [("everyday", "computer_science"), ("everyday", "mathematics"), ("geography", "computer_science"), ("geography", "chemistry")]

# The domains and which others each is compatible with (not symmetric).
COMPATIBLE = {
    "mathematics": ["physics", "computer_science", "engineering", "chemistry", "economics", "philosophy"],
    "physics": ["mathematics", "chemistry", "engineering", "astronomy", "earth_science", "computer_science"],
    "chemistry": ["physics", "biology", "earth_science", "medicine", "engineering", "materials"],
    "biology": ["chemistry", "medicine", "earth_science", "ecology", "psychology", "agriculture"],
    "computer_science": ["mathematics", "physics", "engineering", "linguistics", "philosophy", "economics"],
    "earth_science": ["physics", "chemistry", "biology", "geography", "ecology"],
    "geography": ["earth_science", "history", "economics", "ecology", "biology"],
    "history": ["geography", "philosophy", "economics", "literature", "politics", "religion"],
    "everyday": ["biology", "geography", "economics"],
    "philosophy": ["mathematics", "computer_science", "history", "psychology", "religion", "linguistics"],
    "engineering": ["physics", "mathematics", "chemistry", "materials", "computer_science"],
    "astronomy": ["physics", "mathematics", "earth_science"],
    "medicine": ["biology", "chemistry", "psychology"],
    "ecology": ["biology", "earth_science", "geography", "chemistry"],
    "psychology": ["biology", "philosophy", "medicine", "linguistics"],
    "economics": ["mathematics", "history", "geography", "politics"],
    "agriculture": ["biology", "ecology", "chemistry", "economics"],
    "linguistics": ["philosophy", "computer_science", "psychology", "history"],
    "literature": ["history", "philosophy", "linguistics"],
    "politics": ["history", "economics", "philosophy", "geography"],
    "religion": ["history", "philosophy", "literature", "psychology"],
    "materials": ["chemistry", "physics", "engineering"],
}

# This library's own default keywords, a few under each of the domain labels, which are fixed values; pass ``Domains.from_json`` for a full dictionary.
_KEYWORDS = {
    "mathematics": ["equation", "theorem", "matrix", "probability", "number", "vector"],
    "physics": ["energy", "gravity", "velocity", "acceleration", "wave", "pressure"],
    "chemistry": ["molecule", "acid", "reaction", "compound", "oxidation", "saline"],
    "biology": ["cell", "protein", "photosynthesis", "glucose", "organism", "mossy"],
    "computer_science": ["algorithm", "neural_network", "backpropagation", "assembly", "gradient", "transformer", "attention"],
    "earth_science": ["mineral", "volcanic", "glacial", "sediment", "erosion", "spring"],
    "geography": ["continent", "coastal", "tidal", "delta", "lagoon", "estuary", "island"],
    "history": ["empire", "treaty", "dynasty", "ancient"],
    "everyday": ["kitchen", "furniture", "clothing", "well"],
    "philosophy": ["ethics", "logic", "metaphysics"],
    "engineering": ["pump", "valve", "turbine", "sluice", "culvert", "gauge", "canal"],
    "astronomy": ["telescope", "nebula", "orbit"],
    "medicine": ["vaccine", "surgery", "diagnosis"],
    "ecology": ["marsh", "pond", "habitat", "wetland"],
    "psychology": ["emotion", "perception", "memory"],
    "economics": ["market", "price", "inflation"],
    "agriculture": ["fertile", "terrace", "irrigation", "harvest"],
    "linguistics": ["grammar", "phoneme", "dialect"],
    "literature": ["novel", "poem", "metaphor"],
    "politics": ["parliament", "election", "charter"],
    "religion": ["temple", "ritual", "baptism"],
    "materials": ["ceramic", "alloy", "polymer", "porous", "granular"],
}

# Own default baseline terms under the fixed domain labels: everyday words that a dictionary of technical keywords misses.
_BASELINE = {
    "everyday": ["orange", "cake", "bread", "chair", "table", "car", "house", "fruit"],
    "biology": ["dog", "cat", "fish", "bird", "bone", "tree", "heart", "mamba"],
    "geography": ["france", "germany", "japan", "mountain", "river", "lake"],
    "chemistry": ["water", "oxygen", "hydrogen", "carbon", "iron", "gold"],
    "physics": ["sun", "moon", "star", "planet"],
    "earth_science": ["rock", "sand"],
}


@dataclass
class Domains:
    """A domain dictionary: keywords, baseline terms and the directed compatibility of domains."""

    keywords: dict[str, list[str]] = field(default_factory=lambda: _KEYWORDS)
    baseline: dict[str, list[str]] = field(default_factory=lambda: _BASELINE)
    compatible: dict[str, list[str]] = field(default_factory=lambda: COMPATIBLE)

    @classmethod
    def from_json(cls, path: str) -> Domains:
        """``{"keywords": {domain: [...]}, "baseline": {...}, "compatible": {...}}``; missing parts take the default."""
        with open(path, encoding="utf-8") as f:
            return cls(**json.load(f))

    def keyword_rows(self) -> list[tuple[str, str]]:
        """(keyword, domain); a keyword of several domains goes to the last."""
        return sorted({k: d for d, words in self.keywords.items() for k in words}.items())

    def exact_rows(self) -> list[tuple[str, str]]:
        """(term, domain) for exact matches: baseline terms and keywords."""
        return sorted({(t, d) for d, terms in self.baseline.items() for t in terms} | set(self.keyword_rows()))

    def matrix(self) -> list[tuple[str, str, float]]:
        """(a, b, score) of every pair of domains: 1.0 same, 0.7 b compatible with a, 0.3 a common neighbour, else 0.0."""
        near = {d: {d, *c} for d, c in self.compatible.items()}
        score = lambda a, b: 1.0 if a == b else 0.7 if b in near[a] else 0.3 if near[a] & near[b] else 0.0
        return [(a, b, score(a, b)) for a in near for b in near]


#: Domain labels and keywords of the clustering job, this library's own choice; a parameter of ``domain_clusters``.
CLUSTER_KEYWORDS = {d: _KEYWORDS[d] for d in ("physics", "chemistry", "biology", "geography", "history", "earth_science", "engineering", "ecology")}
