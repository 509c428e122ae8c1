"""Plan helpers: lineage cuts, pair canonicalisation, disjunctive joins."""
