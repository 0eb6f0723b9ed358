"""Table schemas and fixed domains."""

RUN = "struct<fontName: string, height: double, pageNumber: int, text: string, width: double, x: double, y: double>"
TABLES = {
    "documents": "id string, filename string, file_path string, page_count int, status string, error_message string, uploaded_at timestamp",
    "page_chunks": f"id string, document_id string, page_number int, chunk_index int, raw_text string, is_table_heavy boolean, is_low_text boolean, needs_vision boolean, image_path string, position_data array<{RUN}>, token_estimate int, extraction_status string, created_at timestamp",
    "entities": "id string, canonical_name string, entity_type string, context_sample string, embedding array<float>, created_at timestamp",
    "entity_aliases": "id string, entity_id string, surface_form string, document_id string, confidence float, created_at timestamp",
    "fact_types": "id string, name string, description string, example_predicates array<string>, embedding array<float>, created_at timestamp",
    "facts": "id string, document_id string, entity_id string, fact_type_id string, predicate string, value string, raw_value string, unit string, currency string, time_scope string, qualifiers string, embedding array<float>, confidence float, source_page int, source_chunk_index int, source_quote string, source_quote_valid boolean, extracted_at timestamp",
    "relationships": "id string, fact_a_id string, fact_b_id string, relation_type string, explanation string, confidence float, method string, created_at timestamp",
}
RELATION_TYPES = ("corroborates", "contradicts", "reconciled", "uncertain")
METHODS = ("rule", "llm_judge", "both")
CHUNK_STATUSES = ("pending", "extracted", "extraction_failed", "extraction_deferred")


def create_tables(spark, database: str) -> None:
    """Parquet tables of all schemas, if they are not there."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet")
