"""All queries over the given tables, with the SQL that each must agree with."""

from __future__ import annotations

from . import adjacency, aggregates, clusters, exchange, fields, figures, grids, growth, hierarchy, images, kernels, meshes, motion, predicates, rasters, scalars, sequences, spectra, triples

MODULES = (scalars, predicates, aggregates, sequences, clusters, motion, triples, rasters, images, grids, kernels, meshes, adjacency, growth, fields, hierarchy, spectra, figures, exchange)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = "single_linkage"
