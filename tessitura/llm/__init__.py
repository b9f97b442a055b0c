"""Operations on a training-text corpus: filtering, joining, mixing, sharding.

Nothing else in the library imports this subpackage.
"""
