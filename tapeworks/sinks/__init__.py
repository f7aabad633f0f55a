"""Writers (SNK-*): sorted parquet panels, JSONL logs, CSV reports, manifests."""
