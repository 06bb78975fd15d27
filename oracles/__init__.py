"""SQL counterparts of the registered queries, for checking results against another engine."""

from . import metrics, models, states, streaming, stress, tables, targets

SQL: dict[str, str] = {**tables.SQL, **states.SQL, **targets.SQL,
                       **models.SQL, **metrics.SQL,
                       **stress.SQL, **streaming.SQL}
