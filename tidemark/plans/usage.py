"""What operations cost: intents before the send, reports after it, estimates beside both.

Rows are appended once. A second row of the same identity is a duplicate if it says the
same, else a conflict, and the first stays. A missing report is unknown, never zero.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import SAFE
from ..operators import accounting
from .ledger import Ledger, Lease


class Usage:
    def __init__(self, ledger: Ledger, lease: Lease | None, environment: str):
        self.ledger, self.lease, self.environment = ledger, lease, environment

    def _add(self, table: str, row: tuple, more: dict[str, list[tuple]] | None = None) -> None:
        self.ledger.commit(self.lease, {table: [row], **(more or {})}, {"kind": table})

    def record_intent(self, operation: str, attempt: str, member: str | None = None) -> str:
        """recorded, duplicate or conflict."""
        row = (operation, attempt, self.environment, member)
        had = next((r for r in self.ledger.records("intents") if r["operation"] == operation), None)
        if had:
            return "duplicate" if (had["operation"], had["attempt"], had["environment"], had["member"]) == row else "conflict"
        self._add("intents", row)
        return "recorded"

    def acknowledge(self, operation: str, report: str, quantities: dict[str, int]) -> str:
        """acknowledged, duplicate, conflict (the first is kept) or unattributable (no intent). No quantities is a known nothing."""
        if any(not isinstance(v, int) or not 0 <= v <= SAFE for v in quantities.values()):
            raise ValueError("an amount is an integer from 0 to the largest safe one")
        if all(r["operation"] != operation for r in self.ledger.records("intents")):
            return "unattributable"
        content = json.dumps(quantities, sort_keys=True)
        had = next((r for r in self.ledger.records("reports") if (r["operation"], r["report"]) == (operation, report)), None)
        if had:
            return "duplicate" if had["content"] == content else "conflict"
        self._add("reports", (operation, report, content), {"quantities": [(operation, report, u, n) for u, n in sorted(quantities.items())]})
        return "acknowledged"

    def record_estimate(self, operation: str, scope: str, basis: str, quantities: dict[str, int]) -> str:
        """recorded, duplicate or conflict; kept apart from what was observed."""
        rows = [(operation, scope, basis, u, n) for u, n in sorted(quantities.items())]
        had = [(r["operation"], r["scope"], r["basis"], r["unit"], r["amount"]) for r in self.ledger.records("estimates") if (r["operation"], r["scope"]) == (operation, scope)]
        if had:
            return "duplicate" if had == rows else "conflict"
        self.ledger.commit(self.lease, {"estimates": rows}, {"kind": "estimates"})
        return "recorded"

    def tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Intents of this environment, reports and quantities."""
        t = self.ledger.table
        return t("intents").filter(F.col("environment") == self.environment), t("reports"), t("quantities")

    def summary(self) -> DataFrame:
        intents, reports, quantities = self.tables()
        return accounting.usage_summary(intents, reports, quantities, "operation")

    def by_unit(self) -> DataFrame:
        intents, _, quantities = self.tables()
        return accounting.usage_by_unit(quantities.join(intents.select("operation"), "operation", "left_semi"))

    def unknown(self) -> DataFrame:
        intents, reports, _ = self.tables()
        return accounting.unknown_attempts(intents, reports, "operation")
