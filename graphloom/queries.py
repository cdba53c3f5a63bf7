"""All queries over the driver's tables and their oracles."""

from graphloom import catalogue, catalogue_audit, catalogue_links, catalogue_more, catalogue_mutation, catalogue_repair, catalogue_rules  # noqa: F401

QUERIES, ORACLES = catalogue.QUERIES, catalogue.ORACLES  # the other modules add to the first one's
