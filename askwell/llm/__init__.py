"""Operators for preparing text corpora for language-model training.

Ten operators, each in its own module with a DataFrame-in / DataFrame-out
interface; ``queries`` registers one ``opN_<name>`` query per operator and the
five-stage corpus pipeline.  Nothing outside this subpackage imports it.
"""
