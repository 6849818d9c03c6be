"""Operators for training data at scale: token counts, near copies, licences, languages, packing,
sharding, quality and mixing. Nothing else in the library imports this subpackage."""
