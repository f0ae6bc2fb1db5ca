"""The registered queries: importing this package registers them all."""

from tidemark.plans import catalog, in_sql, stored, streams  # noqa: F401
