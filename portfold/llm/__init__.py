"""Operations of a training-data pipeline: scoring, filtering, deduplication, mixing, sharding and packing of documents."""
