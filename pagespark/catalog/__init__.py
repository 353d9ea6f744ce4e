"""The catalog of named queries; each module registers its queries when imported."""


def all_queries():
    from pagespark.catalog import code_queries, dom_queries, io_queries, log_queries, registry, stream_queries  # noqa: F401

    return registry
