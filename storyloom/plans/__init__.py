"""Whole lifecycles as lazy plans over the operators."""
