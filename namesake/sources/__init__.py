"""Tables in and out: schemas, stores, ingest."""
