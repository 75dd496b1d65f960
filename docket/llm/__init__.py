"""Operators for preparing training data: thirteen operators and their registered queries."""
