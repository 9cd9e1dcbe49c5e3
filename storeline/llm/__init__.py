"""Operators for preparing language-model training data.

Ten operators over ``documents``-like tables (LM scoring, mixing, encoding,
quality and toxicity classifiers, near and exact duplicate removal), each in
a module of its own. Nothing else in the library imports this subpackage.
``entry`` registers one query per operator.
"""
