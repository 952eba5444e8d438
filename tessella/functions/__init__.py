"""Column expressions: intervals, alignments, statistics, sequences, strings."""
