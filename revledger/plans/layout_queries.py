"""Layout migration query: move one application into the keyed layout."""

from __future__ import annotations

from revledger.operators.layout import migrate_layout, migrate_tables
from revledger.plans.registry import query
from revledger.streaming.ledger_stream import scratch

MOVED_APPLICATION = "view"
NEW_SCHEMAS_TYPE = "main"


@query("layout_migrate", ("fx_legacy_history", "fx_legacy_current", "fx_history_before"), f"""
with moving as (select 0 as rnk, id, application, datetime, revision, comment, 'history' as source
                from {{fx_legacy_history}} where application = '{MOVED_APPLICATION}'
                union all
                select 1, null, application, datetime, revision, comment, 'current'
                from {{fx_legacy_current}} where application = '{MOVED_APPLICATION}')
select cast(m.top + row_number() over (order by rnk, id) as bigint) as revision_history_id,
       application, '{NEW_SCHEMAS_TYPE}' as schemas_type, datetime, revision, comment, source
from moving, (select max(revision_history_id) as top from {{fx_history_before}}) m
""")
def layout_migrate(fx):
    """Rows of one application entering the new history: old history by id, then old current."""
    _, rows, _, _ = migrate_layout(fx["fx_legacy_current"], fx["fx_legacy_history"],
                                   fx["fx_history_before"], MOVED_APPLICATION, NEW_SCHEMAS_TYPE)
    return rows.select("revision_history_id", "application", "schemas_type", "datetime",
                       "revision", "comment", "source")


@query("layout_migrate_tables", ("fx_legacy_history_kinds", "fx_legacy_current_kinds", "fx_history_kinds"), f"""
with moving as (select kind, 0 as rnk, id, datetime, revision, comment
                from {{fx_legacy_history_kinds}} where application = '{MOVED_APPLICATION}'
                union all
                select kind, 1, null, datetime, revision, comment
                from {{fx_legacy_current_kinds}} where application = '{MOVED_APPLICATION}'),
tops as (select kind, max(revision_history_id) as top from {{fx_history_kinds}} group by kind)
select 'history' as "table", m.kind, cast(t.top + row_number() over (partition by m.kind order by rnk, id) as bigint)
         as revision_history_id, cast(null as bigint) as id,
       '{MOVED_APPLICATION}' as application, '{NEW_SCHEMAS_TYPE}' as schemas_type, datetime, revision, comment
from moving m join tops t on t.kind = m.kind
union all
select 'current', kind, null, null, '{MOVED_APPLICATION}', '{NEW_SCHEMAS_TYPE}', datetime, revision, comment
from moving where rnk = 1
union all
select 'rest_history', kind, null, id, application, null, datetime, revision, comment
from {{fx_legacy_history_kinds}} where application <> '{MOVED_APPLICATION}'
union all
select 'rest_current', kind, null, null, application, null, datetime, revision, comment
from {{fx_legacy_current_kinds}} where application <> '{MOVED_APPLICATION}'
""")
def layout_migrate_tables(fx):
    """Var and func tables moved into the keyed layout by one scan: the new
    history and current rows and what stays, by kind (T3, O2)."""
    out = migrate_tables(fx["fx_legacy_current_kinds"], fx["fx_legacy_history_kinds"], fx["fx_history_kinds"],
                         scratch(fx.spark, "layout"), MOVED_APPLICATION, NEW_SCHEMAS_TYPE)
    return out.select("table", "kind", "revision_history_id", "id", "application", "schemas_type", "datetime",
                      "revision", "comment")
