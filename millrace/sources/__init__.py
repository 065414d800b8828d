"""Landing sources: contracts, file ingestion."""
