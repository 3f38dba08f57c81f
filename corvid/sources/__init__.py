from corvid.sources.parquet import read_table, TABLES
from corvid.sources.csv import clean_column_names, dense_row_number, normalise_missing, read_csv, write_labels

__all__ = ["read_table", "TABLES", "read_csv", "normalise_missing", "clean_column_names", "write_labels", "dense_row_number"]
