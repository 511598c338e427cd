"""Vector retrieval, ranking and data curation as DataFrame plans."""
