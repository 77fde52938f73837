"""Column-level building blocks (expressions, no jobs)."""

from sparkmend.functions.columns import (any_positive_flag, columns_except, columns_with_prefix,
                                         horizontal_sum, hour_floor, parse_datetime,
                                         try_parse_datetime, with_failure_flag, zero_fill)
from sparkmend.functions.onehot import (EventSpec, combined_event_counts, discover_categories,
                                        onehot_count_exprs, onehot_counts)

__all__ = ["any_positive_flag", "columns_except", "columns_with_prefix", "horizontal_sum",
           "hour_floor", "parse_datetime", "try_parse_datetime", "with_failure_flag", "zero_fill",
           "EventSpec", "combined_event_counts", "discover_categories", "onehot_count_exprs",
           "onehot_counts"]
