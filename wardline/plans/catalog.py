"""All registered queries; importing this module fills the registry."""

from wardline.plans import catalog_graph, catalog_models, catalog_rules, catalog_streams, catalog_tables, catalog_text, catalog_windows  # noqa: F401
