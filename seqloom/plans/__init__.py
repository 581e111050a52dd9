"""Registered queries over files made from the tables."""
