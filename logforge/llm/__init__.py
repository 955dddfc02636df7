"""Training-data operators: counting, filtering, deduplicating and encoding documents at corpus scale."""
