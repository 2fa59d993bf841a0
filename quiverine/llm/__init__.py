"""Operators for preparing training data at scale.

Each module holds one operator; ``queries`` names one query per operator.
Nothing else in the library imports this subpackage.
"""
