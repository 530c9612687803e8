"""Training-data operators: tokens, filters, near duplicates, packing and media, as Spark jobs."""
