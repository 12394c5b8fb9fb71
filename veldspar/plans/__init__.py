"""The engine's queries over the test tables, by topic."""


def all_queries() -> tuple[dict, dict]:
    """Queries and their SQL, by name."""
    from veldspar.plans import registry
    from veldspar.plans import adjusting, catalogue, evidence, geometry, governance, imagery, labels, refinement, sensing  # noqa: F401  these add theirs to the registry

    return registry.QUERIES, registry.ORACLES
