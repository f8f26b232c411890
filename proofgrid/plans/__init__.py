"""The registered queries; importing a module of this package registers its queries."""

from proofgrid.plans import crawled, logs, metrics, publish, quality, ranking, retrieval, scalars, texts  # noqa: F401
