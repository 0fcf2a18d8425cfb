"""Named queries; both modules register theirs in ``queries.QUERIES``."""

from marketlab.plans import queries, panel_queries  # noqa: F401, I001
