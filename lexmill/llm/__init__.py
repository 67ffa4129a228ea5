"""Training-data operators: token counts, filters, fingerprints, joins, mixing and token files.

Nothing else in the package imports this subpackage.
"""
