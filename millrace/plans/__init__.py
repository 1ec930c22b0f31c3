"""Operators applied to the driver's tables, and the SQL that says the same."""


def _load():
    from millrace.plans import analytics, attribution, base, events, revenue

    del analytics, attribution, events, revenue
    return base


def queries():
    """All queries by name."""
    return _load().QUERIES


def oracles():
    """The SQL of those that have one."""
    return _load().ORACLES
