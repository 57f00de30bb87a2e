"""Graph operators: merging, validation, traversal, projection, overlay, storage."""
