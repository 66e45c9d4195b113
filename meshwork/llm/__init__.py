"""Operations for building language-model training corpora.

Nothing else in the library imports this subpackage. Every module holds one
operator; ``queries`` registers one query per operator.
"""
