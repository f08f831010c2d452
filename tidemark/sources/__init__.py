"""Readers of landing files: delimited text by field maps, fixed-width tapes and curves, wide tables, XML reports."""

from tidemark.sources.delimited import labelled_values, long_facts, read_delimited, wide_to_long
from tidemark.sources.fields import DATASETS, Field, SourceChanged, by_rule, coverage, mapped
from tidemark.sources.fixed import CURVES, QUOTES, read_curves, read_quotes
from tidemark.sources.reports import read_report

__all__ = ["CURVES", "DATASETS", "QUOTES", "Field", "SourceChanged", "by_rule", "coverage", "labelled_values", "long_facts", "mapped", "read_curves", "read_delimited", "read_quotes", "read_report", "wide_to_long"]
