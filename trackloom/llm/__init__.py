"""Training-data operators: filtering, deduplication, scoring, formatting, sharding and packing."""
