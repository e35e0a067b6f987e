from tessera.functions.columns import (  # noqa: F401
    NA_TOKENS, categorical_columns, clean_missing, is_missing, nan_to_null,
    numeric_columns, ratio_or_zero, stack_rows,
)
from tessera.functions.ranking import prefix_sums  # noqa: F401
