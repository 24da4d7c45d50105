"""Relational operators: mapping, dedup, sampling, anonymisation, audit, chat, evaluation, curves, profiling."""
