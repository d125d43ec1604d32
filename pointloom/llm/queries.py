"""The queries of the operators and the SQL of those that SQL can express."""

from . import bucket_digest, collocations, edit_counts, jaccard, language, language_model, line_labels, packing, perspectives, prefix_trie, quality, sharding, tiling

MODULES = (language_model, sharding, tiling, jaccard, line_labels, perspectives, edit_counts, quality, language, packing, bucket_digest, prefix_trie, collocations)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
