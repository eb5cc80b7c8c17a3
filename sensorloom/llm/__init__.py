"""Operations on training corpora: mixing, scoring, deduplication, derivation, search.

Nothing else in the library imports this subpackage.
"""
