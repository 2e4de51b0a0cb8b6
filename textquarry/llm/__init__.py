"""Operators for preparing language-model training data.

Each module holds one operator with a general interface; ``queries`` registers
the thin query of each operator and ``oracles`` its SQL where SQL can express it.
"""
