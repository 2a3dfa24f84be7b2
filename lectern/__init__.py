"""Spark library for building, checking and scoring labelled text corpora."""
