"""Shipment states of an order item and the sets of states each count leaves out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

STATE = "dwh_shipment_state"

# The state codes of the order system.
INVALID = "item_invalid"
CANCELED = "item_canceled"
RETURNED = "item_returned"
EXCHANGED = "item_exchanged"
REJECTED = "item_rejected"

# States left out of a count. The sets differ between analyses and
# are kept apart on purpose.
GROSS = (INVALID,)
NET_OF_CANCEL = (INVALID, CANCELED)
BEFORE_RETURN_REJ = (INVALID, CANCELED, REJECTED)
AFTER_RETURN_OLD = (INVALID, CANCELED, RETURNED, EXCHANGED)
AFTER_RETURN = (INVALID, CANCELED, RETURNED, REJECTED, EXCHANGED)
AFTER_CANCEL_EXCH = (INVALID, CANCELED, EXCHANGED)

# States counted as sent back.
SENT_BACK = (RETURNED, EXCHANGED, REJECTED)


def outside(states: Iterable[str], column: str | Column = STATE) -> Column:
    """True when the state is known and not in ``states``; NULL for a NULL state, false for a blank one.

    A blank state is a missing one. It is listed here, not turned to NULL, so that the filter reaches the scan.
    """
    return ~_col(column).isin(*states, "")


def inside(states: Iterable[str], column: str | Column = STATE) -> Column:
    return _col(column).isin(*states)


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it is false or NULL."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column
