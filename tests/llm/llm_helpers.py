"""Shared by the tests of the training-data operators."""

#: Names that operators use inside; columns of the input may have them too.
CLASHING = ("uid", "n", "hash", "score", "spans", "shard", "ids", "path", "drop", "own", "own_", "row", "digest", "words", "block", "tree", "node", "class_id", "items", "positive", "label", "part", "vector", "of", "_hit")
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions in old copper kettles"
