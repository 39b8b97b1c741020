"""Jobs over catalogs, tags, edits, lenses, images and benchmarks."""
