"""Raw rows as literals."""

from __future__ import annotations


def unit(name, tier=1, items=(), loc="A1"):
    """One unit record of a raw board."""
    return (name, tier, None if items is None else list(items), loc)


def raw_round(player, opponent, *, match="m", uuid="p", name="2-1", kind="PvP", outcome="victory", ts=1500):
    """One raw round."""
    return (match, uuid, name, kind, outcome, ts, (player, opponent))
