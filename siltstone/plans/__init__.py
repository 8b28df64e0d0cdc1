"""Plan-level helpers: lineage cuts, distributed ranks and running totals, skew handling."""
