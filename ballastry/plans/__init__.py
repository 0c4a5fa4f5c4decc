"""Registered queries, their panels and their SQL."""
