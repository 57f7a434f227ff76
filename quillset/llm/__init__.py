"""Training-data operators: filters, deduplication, decontamination, counting and mixing."""
