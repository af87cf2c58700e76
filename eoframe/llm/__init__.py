"""Operators for preparing training text: tokens, personal data, language, scoring,
near duplicates, decontamination, repeated spans, toxicity, placement, token counts,
alignment of tokenizers and periodic runs.

Nothing outside this subpackage imports it. ``queries`` registers one ``opN_<name>``
query per operator.
"""
