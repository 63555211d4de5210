"""Training-data operators (deduplication, filtering, search, mixing, tokenising).

Nothing else in the library imports this package. Each module holds one
operator and the query ``opN_<name>`` that applies it to its whole table;
``catalog`` lists those queries and the SQL that must give the same rows.
"""
