"""Labels, relationship types and identity rules of the emissions graph."""

from __future__ import annotations

#: Node labels of the closed vocabulary; Entity is what anything else becomes.
LABELS = ("Company", "EmissionMetric", "Scope", "Target", "Year", "Category", "Facility", "Region", "Standard")
FALLBACK_LABEL = "Entity"
QUERY_LABELS = frozenset(LABELS) | {FALLBACK_LABEL}
DEFAULT_SUBJECT = "Company"
DEFAULT_PREDICATE = "RELATED_TO"

#: Label of a predicate's subject, where it is not Company.
SUBJECT_LABELS = {
    "FALLS_UNDER_SCOPE": "EmissionMetric",
    "MEASURED_IN_YEAR": "EmissionMetric",
    "BELONGS_TO_CATEGORY": "EmissionMetric",
    "LOCATED_AT": "Facility",
}

#: Label of a predicate's object, where it is not Entity.
OBJECT_LABELS = {
    "REPORTS_EMISSION": "EmissionMetric",
    "FALLS_UNDER_SCOPE": "Scope",
    "MEASURED_IN_YEAR": "Year",
    "BELONGS_TO_CATEGORY": "Category",
    "COMMITS_TO_NET_ZERO": "Year",
    "SETS_TARGET": "Target",
    "TARGETS_REDUCTION": "EmissionMetric",
    "HAS_SUPPLIER": "Company",
    "SUPPLIES_TO": "Company",
    "OPERATES_IN": "Region",
    "REPORTS_UNDER": "Standard",
    "LOCATED_AT": "Facility",
}

#: Labels that are identified by their value and not by a name.
VALUE_KEYED = ("EmissionMetric", "Year")

#: Properties that a map entry does not repeat as extras.
MAP_HIDDEN = ("latitude", "longitude", "name", "value", "_is_new", "_new_node")
#: Properties that the detail view of a node hides.
DETAIL_HIDDEN = ("_is_new", "_new_node", "geocode_failed")

#: Spend categories and regions of supplier records.
SPEND_CATEGORIES = ("Raw Materials", "Packaging", "Logistics", "Energy", "IT Services", "Manufacturing Components", "Professional Services", "Facilities")
REGIONS = ("North America", "Europe", "Asia Pacific", "Latin America", "Middle East")

#: Example questions and their categories.
SUGGESTIONS = (
    ("Which companies have the highest Scope 3 emissions?", "Emissions"),
    ("What are the net-zero targets in the graph?", "Targets"),
    ("List all Tier 1 suppliers and their regions.", "Supply Chain"),
    ("Which companies report under GRI standards?", "Governance"),
    ("What Scope 3 categories are most common?", "Emissions"),
    ("Which suppliers have the highest annual spend?", "Supply Chain"),
    ("Are there any companies with reduction targets?", "Targets"),
    ("Show me facilities and where they are located.", "Locations"),
)
