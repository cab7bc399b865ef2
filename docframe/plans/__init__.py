"""Session settings and lineage handling shared by the operators."""
