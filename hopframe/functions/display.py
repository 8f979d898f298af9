"""Display-label rules for exported nodes and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_label(columns: list[str]) -> Column:
    """name, else accountId, else the id."""
    picks = [F.col(c).cast("string") for c in ("name", "accountId") if c in columns]
    return F.coalesce(*picks, F.col("id"))


def transfer_label(amount: Column) -> Column:
    return F.concat(F.lit("T->$"), amount.cast("string"))


def numbered_transfer_label(tx_id: Column, amount: Column) -> Column:
    return F.concat(F.lit("$"), tx_id.cast("string"), F.lit("->"), amount.cast("string"))


def link_label(columns: list[str], style: str = "amount") -> Column:
    """Transfers show their amount (``amount``) or number and amount (``numbered``)."""
    plain = F.col("label")
    if style == "numbered" and "transactionId" in columns:
        return F.when(F.col("transactionId").isNotNull(),
                      numbered_transfer_label(F.col("transactionId"), F.col("amount"))).otherwise(plain)
    if style == "amount" and "amount" in columns:
        return F.when(plain == "Transaction", transfer_label(F.col("amount"))).otherwise(plain)
    return plain
