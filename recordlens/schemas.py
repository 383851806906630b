"""Schemas of the stored tables."""

from __future__ import annotations

FIT = "trim string, trim_key string, engine_litres decimal(4,1), engine_cylinders int"

VEHICLES = (
    "vehicle_id long, make string, model string, recall_model string, model_year int, "
    f"display_name string, vin string, {FIT}"
)
DOCUMENTS = (
    "document_id long, vehicle_id long, kind string, external_id string, component string, "
    "filed_on date, title string, body string, raw_payload string"
)
CHUNKS = "chunk_id long, document_id long, ordinal int, text string"
LINKS = (
    "investigation_document_id long, vehicle_id long, campaign_number string, component string, "
    "opened_on date, closed_on date"
)
EMBEDDINGS = "chunk_id long, embedding array<float>"
VIN_DECODES = f"descriptor string, model_year int, {FIT}"
JOBS = (
    "job_id long, vehicle_id long, display_name string, trigger string, state string, "
    "queued_at timestamp, started_at timestamp, finished_at timestamp, message string, report string"
)
EVAL_RUNS = "run_id long, vehicle_id long, ran_at timestamp, case_count long, metrics string"
ANSWERS = (
    "answer_id long, vehicle_id long, question string, answer_json string, "
    "verified_citation_count long, dropped_citation_count long, created_at timestamp"
)
QUERIES = (
    "query_id long, vehicle_id long, text string, mode string, component string, filed_from date, "
    "filed_to date, `limit` int, scope string, trims string"
)

# Record kinds, and the kinds of the pool of official records.
KINDS = ["complaint", "recall", "investigation"]
CAMPAIGN_KINDS = ["recall", "investigation"]
FIT_COLUMNS = ["trim", "trim_key", "engine_litres", "engine_cylinders"]
