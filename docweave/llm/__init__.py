"""Operators for preparing training text: one module per operator, thin contract queries in ``queries``."""
