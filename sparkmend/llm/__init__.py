"""Training-data operators on Spark: scoring, filtering, dedup, mixing and tokenizing of text tables.

Each module holds one operator with a general interface over DataFrames; ``queries`` registers one
``opN_<name>`` query for each of them. Nothing else in the library imports this subpackage.
"""
