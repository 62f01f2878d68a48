from tessera.sources.tables import TABLES, load, read_source
from tessera.sources.stage import (write_stage, write_csv, save_params, load_params,
                                   stringify_text_columns)

__all__ = ["TABLES", "load", "read_source", "write_stage", "write_csv",
           "save_params", "load_params", "stringify_text_columns"]
