"""Operators for preparing training data at scale; nothing else in the package imports this one."""

from importlib import import_module

MODULES = ("quality_repeats", "pii_crf", "language_nb", "line_windows", "packing", "gru_lm", "piece_dropout", "minhash_stars", "suffix_dedup", "ego_join", "token_counts", "whitening", "vector_codes")


def _gather(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__name__}.{name}"), what)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
