"""Row-level operators: joins, audits, gates, total order."""

from sparkmend.operators.audits import (duplicate_keys, duplicate_rows, null_cell_expr, null_cells,
                                        surplus_rows, table_profile)
from sparkmend.operators.gates import (GateError, RawInput, enforce, merged_gate_report,
                                       raw_gate_report)
from sparkmend.operators.joins import left_join
from sparkmend.operators.sort import partitions_for, total_sort, with_position, write_sorted

__all__ = ["duplicate_keys", "duplicate_rows", "null_cell_expr", "null_cells", "surplus_rows",
           "table_profile", "GateError", "RawInput", "enforce", "merged_gate_report",
           "raw_gate_report", "left_join", "total_sort",
           "with_position", "write_sorted", "partitions_for"]
