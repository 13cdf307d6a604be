"""Functions over whole arrays: exports and block processing."""

from tessera.operators.blocks import apply_over_blocks, apply_over_dimension, blocks, map_blocks
from tessera.operators.export import contents, create_dask_array, to_coo, to_csc, to_csr, to_dense_array, to_sparse_array, to_sparse_matrix, write_parquet

__all__ = ["apply_over_blocks", "apply_over_dimension", "blocks", "contents", "create_dask_array", "map_blocks", "to_coo", "to_csc", "to_csr", "to_dense_array", "to_sparse_array", "to_sparse_matrix", "write_parquet"]
