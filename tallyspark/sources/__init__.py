"""Sources: parquet tables, evaluation documents, configuration and small binary formats."""
