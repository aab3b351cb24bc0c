"""Spark jobs for IP-prefix analytics: prefix joins, trace aggregation, inventory matching, log enrichment."""
