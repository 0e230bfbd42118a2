"""Extractors: source files to nodes and relationships.

All languages but Python go through one DataFrame job: lines, block depths, declarations, owners and
ends are columns and windows within a file; a language is a list of rules.
"""
