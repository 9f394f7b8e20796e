"""Parameters of the six ledger tests.

They reach the plans as literals, so Catalyst folds them into filters instead
of joining a one-row relation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame

from auditrank import fixed_values as fv

#: Excluded customers: a short list of ids, or a one-column table of them.
Excluded = Sequence[str] | DataFrame


@dataclass(frozen=True)
class FirstPurchaseParams:
    """Test 02, default on the first purchase."""

    reference_date: date = date(2025, 12, 31)
    registered_from: date = date(2024, 1, 1)
    registered_to: date = date(2025, 12, 31)
    posted_from: date = date(2024, 1, 1)
    posted_to: date = date(2025, 12, 31)
    excluded: Excluded = ()
    id_floor: int = fv.ID_FLOOR
    payment_method: str = fv.PAYMENT_METHOD
    document_type: str = fv.INVOICE_TYPE
    debit_credit: str = fv.DEBIT


@dataclass(frozen=True)
class ReversalParams:
    """Test 03, high volume of reversals."""

    period_from: date = date(2024, 1, 1)
    period_to: date = date(2025, 12, 31)
    excluded: Excluded = ()
    id_floor: int = fv.ID_FLOOR
    account: str = fv.REVERSAL_ACCOUNT
    reversal_mark: str = fv.REVERSAL_MARK
    #: relative rank error of the sketch that brackets the percentiles is 1 / accuracy
    accuracy: int = 100_000


@dataclass(frozen=True)
class OpenItemParams:
    """Tests 01 and 04 (rules inferred from the output columns).

    ``min_days`` is a parameter because the method's text says 30 days while
    one of its file names says 60.  Items of any age count, if posted by the
    reference date.
    """

    reference_date: date = date(2025, 12, 31)
    min_days: int = 30
    high_days: int = 90
    excluded: Excluded = ()
    id_floor: int = fv.ID_FLOOR
    debit_credit: str = fv.DEBIT
    accuracy: int = 100_000


@dataclass(frozen=True)
class ExtensionParams:
    """Test 05, repeated due-date extensions (rule inferred)."""

    min_extensions: int = 2
    high_extensions: int = 3
    excluded: Excluded = ()
    id_floor: int = fv.ID_FLOOR


@dataclass(frozen=True)
class ReturnParams:
    """Test 06, high share of returned sales (rule inferred)."""

    period_from: date = date(2024, 1, 1)
    period_to: date = date(2025, 12, 31)
    excluded: Excluded = ()
    id_floor: int = fv.ID_FLOOR
    document_type: str = fv.INVOICE_TYPE
    debit_credit: str = fv.DEBIT
    accuracy: int = 100_000
