"""Training-data operators: scoring, cleaning, searching, packing and mixing of documents."""
