"""Column expressions."""

from .chance import uniform
from .states import outer_product, single_state, sort_states, zip_states
from .time import epoch_second, weekday_number

__all__ = [
    "epoch_second",
    "outer_product",
    "single_state",
    "sort_states",
    "uniform",
    "weekday_number",
    "zip_states",
]
