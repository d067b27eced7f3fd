"""User-level operators composed from DataFrame primitives.

segments  delivered orders, order totals, persons, the four repeat definitions
prefix    prefix sums over any number of ordered blocks
ranking   global dense rank by order-preserving keys, top-k per group
running   two-level running total
baskets   item-pair co-occurrence counts with hot-basket splitting
gaps      previous event per key without per-key single-task windows
shares    share of the grand total
"""

from mercato.operators.baskets import pair_counts  # noqa: F401
from mercato.operators.gaps import previous_event  # noqa: F401
from mercato.operators.prefix import exclusive_sums  # noqa: F401
from mercato.operators.ranking import global_dense_rank, top_k_per_group  # noqa: F401
from mercato.operators.running import running_total  # noqa: F401
from mercato.operators.shares import share_of_total, share_of_total_decimal  # noqa: F401
