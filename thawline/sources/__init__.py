from thawline.sources.loggers import path_keys, read_loggers, union_networks
from thawline.sources.named import write_files, write_loggers, write_results
from thawline.sources.tables import (
    LAYER_EXCLUDE, cut_lineage, new_folder, pack_cells, pending, read_batches, read_cells, read_part,
    read_points, read_results, read_table, read_vertices, select_layers, shared_folder, write_table,
)

__all__ = [n for n in dir() if not n.startswith("_")]
