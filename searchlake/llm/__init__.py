"""Training-data operators: licence scans, fingerprints, token output, near-duplicate joins,
mixing, URL rules, nearest neighbours, packing, quality and language classifiers.

Nothing else in the library imports this subpackage.
"""
