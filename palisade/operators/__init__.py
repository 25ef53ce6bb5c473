"""Relational operators over evidence: classification, parsing, verdicts, matching, coverage."""
