"""Queries over events, the same functions that run on streams."""

from __future__ import annotations

from scrivena.plans.registry import query
from scrivena.sources.tables import table
from scrivena.streaming import rolling


@query("event_label_counts", "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as events, sum(floor(value))::bigint as whole_value from events group by all")
def event_label_counts(spark, d):
    return rolling.label_counts(table(spark, d, "events"))


@query("event_timeline", "select user_id, strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M:%S') as month, count(*) as events from events group by all")
def event_timeline(spark, d):
    return rolling.author_timeline(table(spark, d, "events"))
