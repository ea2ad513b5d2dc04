"""Operators for large training corpora: decontamination, tokenisation, near and
substring duplicates, media and HTML extraction, binary token stores, toxicity,
quality and personal data.  Nothing outside this subpackage imports it."""
