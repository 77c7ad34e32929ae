"""Sources: images, synthetic masks, vector files, test-table projections."""
