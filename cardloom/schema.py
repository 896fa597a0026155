"""Columns and types of the ledger and the tables beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEDGER = {
    "txn_id": "string", "card": "string", "card_issuer": "string", "card_product": "string", "cardholder": "string",
    "posted_date": "date", "amount": "decimal(18,2)", "raw_description": "string", "normalized_merchant": "string",
    "canonical_merchant": "string", "merchant_source": "string", "proposed_canonical": "string", "source_file": "string",
    "source_document_id": "string", "source_occurrence": "bigint", "category": "string", "subcategory": "string",
    "tags": "array<string>", "classified_by": "string", "proposed_category": "string", "proposed_subcategory": "string",
}
RAW = {
    "posted_date": "date", "amount": "decimal(18,2)", "raw_description": "string", "card": "string", "card_issuer": "string",
    "card_product": "string", "cardholder": "string", "source_file": "string", "source_document_id": "string", "source_row": "bigint",
}
PROPOSAL = (
    "proposal_id", "input_fingerprint", "kind", "status", "members_json", "txn_ids_json", "recommendation_json", "evidence_json",
    "confidence", "model", "prompt_version", "batch_id", "created_at", "updated_at", "error",
)


def conform(df: DataFrame, columns: dict[str, str] = LEDGER) -> DataFrame:
    """Exactly these columns, missing ones null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
