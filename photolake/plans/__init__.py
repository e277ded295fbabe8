"""Move and export plans, and the registered queries of the catalog jobs."""
