"""Names and ranks that the record types use."""

from __future__ import annotations

# The names of node types, edge types, evidence sources and confidence levels, and their numbers.
NODE_TYPES = (
    "file directory module package class trait interface function method field endpoint database_table collection queue topic "
    "config_key test build_target runtime_error ticket pull_request resource architecture_component"
).split()
EDGE_TYPES = (
    "CONTAINS DEFINES REFERENCES CALLS IMPLEMENTS EXTENDS IMPORTS DEPENDS_ON EXPOSES_ENDPOINT CALLS_ENDPOINT READS_CONFIG WRITES_CONFIG "
    "READS_TABLE WRITES_TABLE PUBLISHES_EVENT CONSUMES_EVENT TESTS TEST_COVERS VALIDATES OWNED_BY CHANGED_BY FAILED_IN BELONGS_TO "
    "MENTIONED_IN RELATED_TO_TICKET SIMILAR_TO SEMANTICALLY_RELATED"
).split()
CONFIDENCE = {"low": 0.35, "medium": 0.6, "high": 0.85, "exact": 1.0}
CONFIDENCE_FROM = (("exact", 0.95), ("high", 0.75), ("medium", 0.55))
