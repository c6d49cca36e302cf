"""Layer plans (L1-L3), the warehouse wiring, reports and the query registry."""
