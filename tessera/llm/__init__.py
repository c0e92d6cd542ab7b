"""Operations of a training-data pipeline: near duplicates, scoring, tokens, search, mixing and packing.

Nothing else in the library imports this package.
"""
