"""Detectors. Each turns columns of one file row into an array of findings, without moving a row."""
