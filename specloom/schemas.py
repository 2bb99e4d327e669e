"""Table schemas and seed rows of the knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ATTRS = "map<string,string>"
NODE = (
    "id string, kind string, parent_id string, slug string, dimension_code string, body string, version int, supersedes_id string, "
    f"source_commit string, status string, attrs {ATTRS}, content_hash string, created_at timestamp"
)
CHUNK = "chunk_id string, node_id string, ord int, embedding array<float>, tier string, chunk_text string, content_hash string, embedding_model_version string, pipeline_version string"
LINK = f"id string, src_id string, dst_id string, dst_urn string, dst_ref string, rel string, pending boolean, attrs {ATTRS}, created_at timestamp"
DIMENSION = "code string, label string, description string"
LINK_TYPE = "code string, label string, description string, directed boolean"
SUMMARY = "capability_slug string, source_commit string, nodes_created int, nodes_versioned int, nodes_skipped int, nodes_vanished int, dimensions_seen array<string>, sources_unreached array<string>, idempotent_hit boolean"
LEDGER = f"capability_slug string, source_commit string, summary struct<{SUMMARY.replace(' ', ':').replace(',:', ',')}>, created_at timestamp"
FILES = "archive string, ord int, path string, body string"
TABLES = {"node": NODE, "chunk": CHUNK, "spec_link": LINK, "spec_dimension": DIMENSION, "link_type": LINK_TYPE, "ingestion": LEDGER}

# The governed dimensions and link types.
DIMENSIONS = [
    ("context-and-requirements", "Context and Requirements"),
    ("quality-attributes", "Quality Attributes"),
    ("constraints", "Constraints"),
    ("architecture-diagrams", "Architecture Diagrams"),
    ("infrastructure-costs", "Infrastructure Costs"),
    ("architectural-decisions", "Architectural Decisions"),
    ("risks-and-technical-debts", "Risks and Technical Debts"),
    ("processes", "Processes"),
    ("solution-requirements", "Solution Requirements"),
    ("data-requirements", "Data Requirements"),
    ("business-rules", "Business Rules"),
]
LINK_TYPES = [
    ("belongs_to", "Belongs To"),
    ("derives_from", "Derives From"),
    ("supersedes", "Supersedes"),
    ("realizes", "Realizes"),
    ("traces_to", "Traces To"),
    ("depends_on", "Depends On"),
    ("contains", "Contains"),
    ("affects-entity", "Affects Entity"),
    ("performed-by", "Performed By"),
    ("integrates-with", "Integrates With"),
    ("broader", "Broader"),
    ("conflicts-with", "Conflicts With"),
    ("refines", "Refines"),
    ("satisfies", "Satisfies"),
    ("addresses", "Addresses"),
    ("constrains", "Constrains"),
    ("serves", "Serves"),
    ("governed-by", "Governed By"),
    ("threatens", "Threatens"),
    ("mitigated-by", "Mitigated By"),
    ("accepted-by", "Accepted By"),
]


def seed_dimensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, label, None) for c, label in DIMENSIONS], DIMENSION)


def seed_link_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, label, None, True) for c, label in LINK_TYPES], LINK_TYPE)


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    """All tables of a new knowledge base, whitelists seeded."""
    state = {name: spark.createDataFrame([], ddl) for name, ddl in TABLES.items()}
    return state | {"spec_dimension": seed_dimensions(spark), "link_type": seed_link_types(spark)}
