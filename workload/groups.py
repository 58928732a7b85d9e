"""Predicates both sides of the comparison use. They are SQL text, as users save them."""

PRESET = (
    "read_depth >= 10 AND genotype_quality >= 70"
    " AND ( consensus_maf <= 0.01 OR consensus_maf IS NULL )"
)
CASE = f"{PRESET} AND pathology = 'BUILDING'"
CONTROL = f"{PRESET} AND pathology = 'MACHINERY'"

# without the quality preset: dense groups, whose variants differ in frequency
ALL_CASE = "pathology = 'BUILDING'"
ALL_CONTROL = "pathology = 'MACHINERY'"

# by call, not by sample: most samples are in both groups
HIGH = "snpeff_impact = 'HIGH'"
LOW = "snpeff_impact = 'LOW'"

PANEL = ["Brand#11/STANDARD", "Brand#12/SMALL", "Brand#13/PROMO", "Brand#21/LARGE", "Brand#25/ECONOMY"]
SAMPLE_TEXT = "sample_id IN('1 , 4 , 7 , 10,13 ,16') AND filters = 'PASS'"
SAMPLE_TEXT_EXPANDED = "sample_id IN ('1','4','7','10','13','16') AND filters = 'PASS'"

SAVED = [
    ("building_rare", CASE),
    ("machinery_rare", CONTROL),
    ("samples", SAMPLE_TEXT),
]
