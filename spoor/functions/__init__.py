"""Column functions: vocabularies, buckets, paths, tokens, and the few that need Python."""
