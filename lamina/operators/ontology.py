"""The ontology: node classes with identity keys, directed edge rules, and the classes of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Node classes and their identity keys (fixed values).
IDENTITY_KEYS = {
    "Organization": ["name"], "Person": ["name"], "Facility": ["name"], "Product": ["name"], "Material": ["name"],
    "Emission": ["category", "scope", "valid_from"], "Waste": ["category", "valid_from"],
    "KPIObservation": ["kpi_type", "source_id", "year", "target_year", "baseline_year"],
    "Standard": ["name", "valid_from"], "Certification": ["name", "valid_from", "validity_period"], "Regulation": ["name", "jurisdiction"],
    "Initiative": ["name"], "Goal": ["name"], "SustainabilityClaim": ["claim_id"], "ThirdPartyVerification": ["verification_id"],
    "CarbonOffsetProject": ["project_id"], "ScienceBasedTarget": ["target_id"], "Controversy": ["controversy_id"], "Penalty": ["penalty_id"],
    "MediaReport": ["report_id"], "Community": ["name"], "Location": ["name", "country"], "Authority": ["name", "jurisdiction"],
    "Country": ["name"], "ClaimKeyword": ["term"], "Investment": ["investor", "investee", "date"], "Project": ["name"],
}
#: Directed edge rules: label, then source and target classes (fixed values).
EDGE_RULES = """
usesMaterial Product Material; generatesEmission Facility Emission; generatesEmission Organization Emission; generatesWaste Facility Waste;
impactsCommunity Organization Community; adoptsStandard Organization Standard; holdsCertification Organization Certification; holdsCertification Facility Certification;
subjectToRegulation Organization Regulation; takesPartIn Organization Initiative; setsGoal Organization Goal; partOf Facility Organization;
reducesEmission Initiative Emission; reducesWaste Initiative Waste; aimsForCertification Initiative Certification; reportsKPI Organization KPIObservation;
observedAtFacility KPIObservation Facility; claims Organization SustainabilityClaim; verifiedBy SustainabilityClaim ThirdPartyVerification; verifiedBy SustainabilityClaim KPIObservation;
contradictedBy SustainabilityClaim Controversy; contradictedByMedia SustainabilityClaim MediaReport; subjectToPenalty Organization Penalty; offsetsWith Organization CarbonOffsetProject;
targetsScienceBased Organization ScienceBasedTarget; manufacturedAt Product Facility; producedBy Product Organization; suppliedBy Product Organization;
ownsFacility Organization Facility; publishesReport Organization MediaReport; locatedIn Organization Location; locatedIn Facility Location;
locatedIn CarbonOffsetProject Location; locatedIn Community Location; locatedIn Project Location; enforcedBy Penalty Authority;
issuedBy Certification Authority; issuedBy Standard Authority; isIn Location Country; reportedBy MediaReport Person;
mentionsOrganization MediaReport Organization; mentionsProduct MediaReport Product; involvedIn Person Product; involvedIn Person CarbonOffsetProject;
involvedIn Person Project; worksAt Person Organization; hasKeyword SustainabilityClaim ClaimKeyword; owns Organization Organization;
partnersWith Organization Organization; investsIn Organization Investment; investedIn Investment Project; sourcedFrom Material Organization;
sourcedFrom Material Location; ownedBy Project Organization; supersedes Organization Organization; supersedes Facility Facility;
supersedes Person Person; supersedes Goal Goal; supersedes Standard Standard; supersedes Product Product;
supersedes Material Material; supersedes Certification Certification; supersedes Regulation Regulation
"""
#: Classes of single observations, which names alone never merge (fixed values).
OBSERVATIONS = (
    "KPIObservation", "Emission", "Waste", "SustainabilityClaim", "Controversy", "Penalty", "MediaReport", "Investment", "ThirdPartyVerification", "ScienceBasedTarget", "CarbonOffsetProject",
)
#: Keys of the validity that every class carries (fixed values).
TEMPORAL = ("valid_from", "valid_to", "is_current")


def rules() -> list[tuple[str, str, str]]:
    return [tuple(r.split()) for r in EDGE_RULES.split(";")]


def rule_table(spark: SparkSession) -> DataFrame:
    """The edge rules, of fixed size."""
    return spark.createDataFrame(rules(), "label string, src string, dst string")


def class_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(IDENTITY_KEYS.items()), "class string, identity_keys array<string>")


def versioned_classes() -> list[str]:
    """Classes with a supersedes edge to themselves."""
    return [s for label, s, d in rules() if label == "supersedes" and s == d]
