"""Probe targets still to be traced."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cidrloom.operators.traces import expand_targets, ordered_union, remaining_targets


def plan_targets(whois_nets: DataFrame, sheet_nets: DataFrame, traces: DataFrame, full: bool = False) -> DataFrame:
    """`net, ip` pairs of both prefix tables (`net, ord`) that no trace covers."""
    nets = ordered_union(whois_nets, sheet_nets, "net", "ord")
    return remaining_targets(expand_targets(nets, "net", full), "net", "ip", traces)
