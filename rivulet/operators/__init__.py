"""DataFrame -> DataFrame operators."""

from rivulet.operators import control, history, joins, ordering, routing, sqlstep, transform, udf

__all__ = ["control", "history", "joins", "ordering", "routing", "sqlstep", "transform", "udf"]
