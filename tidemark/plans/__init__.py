"""Registered queries, each with SQL that computes the same, and reports."""
