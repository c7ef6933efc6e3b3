"""Runs: configuration, planning, execution with resume, publication and status."""
