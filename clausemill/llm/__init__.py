"""Training-data operators: mixing, quality, identifiers, packing, line and near-duplicate
removal, token files, fingerprints, language ID and interleaved media.

Nothing else in the library imports this subpackage.
"""
