"""Training-data operators: near-duplicate joins, classifiers, language-model scoring, tokenisation, formatting.

Nothing else in the library imports this subpackage; ``registry`` holds its queries.
"""
