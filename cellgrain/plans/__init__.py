"""Workflows and the catalogue of registered queries."""


def catalogues():
    from . import cell_queries, choice_queries, pair_queries, pattern_queries, window_queries

    return [pattern_queries.catalogue, cell_queries.catalogue, pair_queries.catalogue, choice_queries.catalogue, window_queries.catalogue]
