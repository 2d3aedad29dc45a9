"""Training-data operators: near-dedup, personal data, packing, token files, decontamination, licences, scoring.

Nothing else in the library imports this subpackage.
"""
