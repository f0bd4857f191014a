"""Readers, file audits, contracts and typed sinks."""
