"""Training-data operators: tokenising, deduplication, scanning, filtering, search, sharding and mixing."""
