from dayweave.sources.csv import read_scored_csv, read_with_position, write_scored_csv
from dayweave.sources.csv_ranges import csv_records
from dayweave.sources.scratch import delete, materialize, scratch_folder, scratch_path, scratch_space
from dayweave.sources.tables import read_in_order, write_sorted
from dayweave.sources.wide_csv import read_wide_csv, write_wide_csv

__all__ = [
    "csv_records",
    "delete",
    "materialize",
    "read_in_order",
    "read_scored_csv",
    "read_wide_csv",
    "read_with_position",
    "scratch_folder",
    "scratch_path",
    "scratch_space",
    "write_scored_csv",
    "write_sorted",
    "write_wide_csv",
]
