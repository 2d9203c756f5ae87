"""Shared rate gates: an operation passes all of its gates together or waits."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Gate:
    """At most ``units`` of committed cost in any ``interval``; a cooldown sets a floor."""

    units: int
    interval: int
    debits: list[tuple[int, int]] = field(default_factory=list)
    reserved: int = 0
    cooldown: int = 0

    def wait(self, cost: int, now: int) -> int | None:
        """The earliest instant at which the cost fits; None if it never can."""
        if cost > self.units:
            return None
        self.debits = [(t, c) for t, c in self.debits if t > now - self.interval]
        used, at = sum(c for _, c in self.debits) + self.reserved, now
        for t, c in sorted(self.debits):
            if used + cost <= self.units:
                break
            used, at = used - c, t + self.interval
        if used + cost > self.units:
            return max(now + 1, self.cooldown)  # only reservations are in the way
        return max(at, self.cooldown)


class RateSurface:
    def __init__(self):
        self.gates: dict[str, Gate] = {}
        self.open: dict[int, dict[str, int]] = {}
        self.count = 0

    def register(self, name: str, units: int, interval: int) -> None:
        had = self.gates.get(name)
        if had and (had.units, had.interval) != (units, interval):
            raise ValueError(f"gate {name} is registered with other limits")
        self.gates.setdefault(name, Gate(units, interval))

    def admit(self, costs: dict[str, int], now: int) -> tuple[int | None, int | None]:
        """(reservation, None), or (None, the instant to try again; None for never)."""
        waits = [self.gates[g].wait(c, now) for g, c in costs.items()]
        if None in waits:
            return None, None
        if any(w > now for w in waits):
            return None, max(waits)
        self.count += 1
        self.open[self.count] = costs
        for g, c in costs.items():
            self.gates[g].reserved += c
        return self.count, None

    def _close(self, reservation: int) -> dict[str, int]:
        costs = self.open.pop(reservation)
        for g, c in costs.items():
            self.gates[g].reserved -= c
        return costs

    def commit(self, reservation: int, now: int) -> None:
        """The send may have happened: its cost counts from now."""
        for g, c in self._close(reservation).items():
            self.gates[g].debits.append((now, c))

    def rollback(self, reservation: int) -> None:
        self._close(reservation)

    def observe_cooldown(self, name: str, until: int) -> None:
        self.gates[name].cooldown = max(self.gates[name].cooldown, until)
