"""Training-data operators: extraction, language id, mixing, deduplication,
decontamination, licence and personal-data scans, search and LM scoring.

Nothing else in the library imports this package.
"""
