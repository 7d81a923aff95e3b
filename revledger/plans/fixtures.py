"""Fixture views: rows in the schemas the operators expect, derived from the
driver's tables so that their volume grows with the scale factor.

Every view is SQL text that runs unchanged in Spark SQL and in DuckDB.
Table references are written ``{name}``; Spark binds them to DataFrames
through ``spark.sql(text, **frames)`` and the DuckDB oracle binds them to
CTE / view names. The few dialect gaps are ``@TOKEN@`` markers.

The views only shape input rows. None of them does an operator's work.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from revledger.session import TABLES, read_table, written

DIALECT = {
    "spark": {"@TS_NTZ@": "timestamp_ntz", "@ARRAY@": "array"},
    "duckdb": {"@TS_NTZ@": "timestamp", "@ARRAY@": "list_value"},
}

# name -> (sql, names it reads)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}


def _view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (sql.strip(), deps)


_view("fx_history", ("events",), """
select event_id as revision_history_id, event_type as application,
       cast(user_id as string) as schemas_type,
       cast(date_trunc('day', ts) as @TS_NTZ@) as datetime,
       concat(case when event_id % 10 = 0 then 'pre-' else 'r' end, cast(event_id % 7 as string)) as revision,
       case when event_id % 3 = 0 then null else props end as comment
from {events}
""")

# the same pushes with a ledger kind: even ids were var pushes, odd ids func
_view("fx_history_kinds", ("fx_history",), """
select *, case when revision_history_id % 2 = 0 then 'var' else 'func' end as kind
from {fx_history}
""")

_view("fx_current", ("fx_history",), """
select revision_history_id, application, schemas_type, datetime, revision, comment
from (select *, row_number() over (partition by application, schemas_type
                                   order by revision_history_id desc) as k
      from {fx_history} where datetime < timestamp '2024-01-25 00:00:00') x
where k = 1
""")

# the ledger a fortnight earlier, when part of the keys had no row yet
_view("fx_current_old", ("fx_history",), """
select revision_history_id, application, schemas_type, datetime, revision, comment
from (select *, row_number() over (partition by application, schemas_type
                                   order by revision_history_id desc) as k
      from {fx_history} where datetime < timestamp '2024-01-08 00:00:00') x
where k = 1
""")

_view("fx_history_before", ("fx_history",), """
select * from {fx_history} where datetime < timestamp '2024-01-25 00:00:00'
""")

# every push since then, keys repeated inside the batch included
_view("fx_pushes", ("fx_history",), """
select revision_history_id, application, schemas_type, datetime, revision, comment
from {fx_history} where datetime >= timestamp '2024-01-25 00:00:00'
""")

_view("fx_batch", ("fx_history",), """
select revision_history_id, application, schemas_type, datetime, revision, comment
from (select *, row_number() over (partition by application, schemas_type
                                   order by revision_history_id desc) as k
      from {fx_history} where datetime >= timestamp '2024-01-25 00:00:00') x
where k = 1
""")

_view("fx_nodes", ("orders",), """
select o_custkey as application, o_orderpriority as priority, o_orderstatus as status,
       cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as bigint) as rev,
       cast(count(*) over (partition by o_custkey) as bigint) as target_rev
from {orders}
""")

_view("fx_edges", ("fx_nodes",), """
select application, rev as from_rev, rev + 1 as to_rev from {fx_nodes} where rev < target_rev
union all
select application, rev, rev + 2 from {fx_nodes}
where rev + 2 <= target_rev and priority in ('1-URGENT', '2-HIGH')
""")

_view("fx_starts", ("fx_nodes",), """
select application, rev as from_rev, target_rev from {fx_nodes}
union all
select distinct application, cast(0 as bigint), target_rev from {fx_nodes}
""")

# migration descriptors in their nested shape: one row per (application, revision)
# with the list of revisions it is compatible with
_view("fx_migrations", ("fx_edges",), """
select application, to_rev, array_agg(from_rev) as compatible
from {fx_edges} group by application, to_rev
""")

# migration entries that carry upgrade scripts; a 'P' node lists only rev-1
# (so a +2 hop into it has no entry) and 'F'/'5-LOW' nodes get a second entry
# for rev-1 (so that hop has two entries)
_view("fx_migration_entries", ("fx_nodes",), """
select application, concat('a', cast(rev as string)) as migration_id, rev as to_rev,
       case when status = 'P' then @ARRAY@(rev - 1) else @ARRAY@(rev - 1, rev - 2) end as compatible
from {fx_nodes}
union all
select application, concat('b', cast(rev as string)), rev, @ARRAY@(rev - 1)
from {fx_nodes} where status = 'F' and priority = '5-LOW'
""")

_view("fx_upgrade_scripts", ("fx_nodes",), """
select application, concat('a', cast(rev as string)) as migration_id, 'main' as upgrade_type,
       1 as pos, concat('a', cast(rev as string), '-main.sql') as script
from {fx_nodes}
union all
select application, concat('a', cast(rev as string)), 'main', 2,
       concat('a', cast(rev as string), '-', priority, '.sql')
from {fx_nodes}
union all
select application, concat('a', cast(rev as string)), 'replica', 1,
       concat('a', cast(rev as string), '-replica.sql')
from {fx_nodes}
union all
select application, concat('b', cast(rev as string)), 'main', 1,
       concat('b', cast(rev as string), '-main.sql')
from {fx_nodes} where status = 'F' and priority = '5-LOW'
""")

_view("fx_hosts", ("customer",), """
select c_custkey as host_id, c_name as name,
       case when c_custkey % 20 = 0 then null else cast(c_nationkey as string) end as type,
       c_mktsegment as segment
from {customer}
""")

_view("fx_schemas", ("supplier",), """
select s_suppkey as schema_key, cast(s_nationkey as string) as schemas_type, s_name as name,
       case when s_suppkey % 3 = 0 then 'func' when s_suppkey % 17 = 0 then 'temp' else 'var' end as kind,
       concat('role_', cast(s_nationkey as string)) as owner
from {supplier}
""")

# declared grants: the roles of every nation in the schema's region (the
# owner's own role among them); region 0 declares no grant list at all
_view("fx_grants_declared", ("supplier", "nation"), """
select s.s_suppkey as schema_key, concat('role_', cast(s.s_nationkey as string)) as owner,
       case when n1.n_regionkey = 0 then null
            else array_agg(distinct concat('role_', cast(n2.n_nationkey as string))) end as grants
from {supplier} s
join {nation} n1 on n1.n_nationkey = s.s_nationkey
join {nation} n2 on n2.n_regionkey = n1.n_regionkey
group by s.s_suppkey, s.s_nationkey, n1.n_regionkey
""")

_view("fx_grants_observed", ("lineitem", "fx_schemas"), """
select distinct schema_key,
       case when l_quantity < 45 then owner else 'role_x' end as grantor,
       concat(case when l_returnflag = 'R' then 'role_' else 'former_' end, cast(l_partkey % 25 as string)) as grantee,
       case when l_linestatus = 'O' then 'USAGE' else 'CREATE' end as privilege,
       l_discount > 0.09 as is_grantable
from {lineitem} join {fx_schemas} on schema_key = l_suppkey
""")

# observed ACL items by role oid (0 = public), for the role-name lookup
_view("fx_acl_oids", ("lineitem", "supplier"), """
select distinct l_suppkey as schema_key, cast(s_nationkey as bigint) as grantor_oid,
       cast(l_linenumber + 20 as bigint) as grantee_oid,
       case when l_linestatus = 'O' then 'USAGE' else 'CREATE' end as privilege
from {lineitem} join {supplier} on s_suppkey = l_suppkey
""")

_view("fx_roles", ("nation",), """
select cast(n_nationkey as bigint) as oid, lower(n_name) as rolname from {nation}
""")

_view("fx_scripts", ("documents", "labels"), """
select d.source as dir, d.doc_id as file_id, concat(d.source, '/', d.lang, '/', cast(d.doc_id as string),
       case when d.doc_id % 4 = 0 then '.txt' else '.sql' end) as path, d.text as text,
       case when l.toxic = 1 then 'last' when l.quality = 1 then 'first' else 'regular' end as file_path_type
from {documents} d left join {labels} l on l.doc_id = d.doc_id
""")

# the corpus as files: folders and names with a space, a plus and a dot
_view("fx_script_files", ("fx_scripts",), """
select concat(dir, '.v1+x/sub ', cast(file_id % 3 as string), '/', cast(file_id as string), ' f',
              case when file_id % 4 = 0 then '.txt' else '.sql' end) as path, text
from {fx_scripts}
""")

_view("fx_includes", ("fx_scripts",), """
select file_id, case when file_id % 3 = 0 then concat('$', '{{', dir, '}}/', path)
                     when file_id % 3 = 1 then concat('$', dir, '/', path)
                     else path end as include
from {fx_scripts}
""")

_view("fx_include_refs", ("fx_scripts",), """
select distinct case when dir in ('src4', 'src7') then concat(dir, '-old') else dir end as ref_name,
       concat('/srv/', dir) as ref_value from {fx_scripts}
""")

# required objects: small parts are required under a key no line ever has
_view("fx_required", ("part",), """
select case when p_size < 10 then p_partkey + 1000000000 else p_partkey end as object_id from {part}
""")

_view("fx_catalog", ("lineitem",), """
select distinct l_partkey as object_id from {lineitem}
""")

_view("fx_settings_compat", ("orders",), """
select distinct o_custkey as application,
       case when o_orderstatus = 'F' then o_orderpriority else concat(o_orderpriority, '+') end as revision
from {orders}
""")

_view("fx_sources", ("orders",), """
select o_orderkey as source_id,
       case when o_orderstatus = 'P' then -o_custkey else o_custkey end as application,
       o_orderpriority as revision
from {orders}
""")


# parents of hosts: one per market segment, its type the smallest nation
# key of the segment; BUILDING declares no type
_view("fx_segments", ("customer",), """
select c_mktsegment as segment,
       case when c_mktsegment = 'BUILDING' then null else cast(min(c_nationkey) as string) end as type
from {customer} group by c_mktsegment
""")

# per schemas type: which single-script phases it declares
_view("fx_groups", ("nation",), """
select cast(n_nationkey as string) as schemas_type, n_nationkey % 2 = 0 as has_init,
       n_nationkey % 3 = 0 as has_late, n_nationkey % 5 = 0 as has_safeguard
from {nation}
""")

_view("fx_param_hosts", ("events",), """
select event_id as host_id, concat(event_type, '-', cast(user_id as string)) as name,
       event_type as type, props as params
from {events}
""")

_view("fx_settings_clusters", ("fx_settings_compat",), """
select application, array_agg(revision) as compatible from {fx_settings_compat} group by application
""")

# recorded schema lists per customer (one per order) and declared lists
# (one own schema and one shared by the market segment; every 7th declares none)
_view("fx_recorded", ("orders",), """
select o_custkey as application, array_agg(concat('s', cast(o_orderkey as string))) as schemas
from {orders} group by o_custkey
""")

_view("fx_declared", ("customer",), """
select c_custkey as application,
       case when c_custkey % 7 = 0 then null
            else @ARRAY@(concat('s', cast(c_custkey as string)), concat('x', c_mktsegment)) end as schemas
from {customer}
""")

_view("fx_routines", ("part",), """
select concat('s', cast(p_partkey as string)) as schema_name, p_name as routine_name, p_type as args
from {part}
""")

_view("fx_versions", ("customer",), """
select c_custkey as application,
       case when c_acctbal < 0 then 'PostgreSQL 9.6.24 on x86_64'
            when c_acctbal < 3000 then 'PostgreSQL 10.23 on x86_64'
            when c_acctbal < 6000 then 'PostgreSQL 100.1 on x86_64'
            else 'PostgreSQL 16.2 on x86_64' end as server_version
from {customer}
""")

# include groups for pinned ordering: group = language, include dirs =
# sources (dir_pos from the source number), file name = document id
_view("fx_files", ("documents",), """
select lang as grp, source as dir, cast(substr(source, 4) as int) as dir_pos,
       concat(cast(doc_id as string), '.sql') as name, doc_id as file_id
from {documents}
""")

# inline scripts of a group: one behind its regular files, every language but one
_view("fx_inline", ("documents",), """
select distinct lang as grp, 'inline' as dir, 0 as dir_pos, concat('inline-', lang) as name
from {documents} where lang <> 'en'
""")

# files as the include directories of a group list them, by real path: some
# are reached through two directories, a few through three
_view("fx_listed_files", ("fx_files",), """
select grp, concat(dir, '/', name) as path, dir_pos from {fx_files}
union all
select grp, concat(dir, '/', name), dir_pos + 100 from {fx_files} where file_id % 40 = 0
union all
select grp, concat(dir, '/', name), dir_pos + 200 from {fx_files} where file_id % 120 = 0
""")

# pins of labelled documents in their group: toxic ones last, the others first;
# every tenth pin names a group without such a file
_view("fx_pins", ("labels", "documents"), """
select case when l.doc_id % 10 = 0 then 'xx' else d.lang end as grp,
       concat(cast(l.doc_id as string), '.sql') as name,
       case when l.toxic = 1 then 'last' else 'first' end as which, l.doc_id as pin_pos
from {labels} l join {documents} d on d.doc_id = l.doc_id
""")

_view("fx_roots", ("pages",), """
select distinct concat('src', cast(page_id % 7 as string), '/',
                       case when page_id % 2 = 0 then 'en' else 'fr' end) as root
from {pages}
""")

_view("fx_list_fields", ("pages",), """
select page_id,
       case when page_id % 5 = 0 then null
            when page_id % 11 = 3 then concat('[draft] ', cast(page_id as string), '.sql')
            when page_id % 2 = 0 then concat('["', url, '", "p', cast(page_id as string), '"]')
            else url end as field
from {pages}
""")


# the old layout: keyed by application only
_view("fx_legacy_history", ("fx_history",), """
select revision_history_id as id, application, datetime, revision, comment from {fx_history}
""")

# the same as separate var and func tables: even ids were var pushes
_view("fx_legacy_history_kinds", ("fx_legacy_history",), """
select *, case when id % 2 = 0 then 'var' else 'func' end as kind from {fx_legacy_history}
""")

_view("fx_legacy_current_kinds", ("fx_legacy_history_kinds",), """
select application, datetime, revision, comment, kind
from (select *, row_number() over (partition by application, kind order by id desc) as k
      from {fx_legacy_history_kinds}) x
where k = 1
""")

_view("fx_legacy_current", ("fx_legacy_history",), """
select application, datetime, revision, comment
from (select *, row_number() over (partition by application order by id desc) as k
      from {fx_legacy_history}) x
where k = 1
""")


# a fleet: an application has a host for each priority of its orders, with
# the number of that priority's finished orders as stored revision. Hosts of
# the low priorities follow one revision behind; every other host is a main
_view("fx_fleet", ("orders", "customer"), """
select concat(cast(o_custkey as string), '-', substr(o_orderpriority, 1, 1)) as host_id,
       o_custkey as application, cast(min(c_nationkey) as string) as group_type,
       case when substr(o_orderpriority, 1, 1) in ('1', '3', '5') then 'main' else 'replica' end as upgrade_type,
       cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as from_rev,
       min(n) - case when o_orderpriority = '5-LOW' then 1 else 0 end as target_rev
from (select *, cast(count(*) over (partition by o_custkey) as bigint) as n from {orders}) o
join {customer} on c_custkey = o_custkey
group by o_custkey, o_orderpriority
""")

# settings clusters: a list for each host type, as an install reads it, ...
_view("fx_settings", ("nation",), """
select cast(n_nationkey as string) as settings_type, cast(100 as bigint) as pos, concat('s1-', n_name, '.sql') as script
from {nation} where n_nationkey % 4 <> 3
union all
select cast(n_nationkey as string), cast(200 + n_regionkey as bigint), concat('s2-', n_name, '.sql')
from {nation} where n_nationkey % 2 = 0
union all
select cast(n_nationkey as string), cast(210 as bigint), 's2-last.sql' from {nation} where n_nationkey % 2 = 0
""")

# ... and for each application the clusters with migrations of their own:
# some lack the entry of a hop, some have it twice
_view("fx_settings_list", ("fx_nodes",), """
select distinct application, 1 as cluster_no from {fx_nodes}
union all
select distinct application, 2 from {fx_nodes} where application % 2 = 0
""")

_view("fx_settings_entries", ("fx_nodes",), """
select application, 1 as cluster_no, concat('s', cast(rev as string)) as migration_id, rev as to_rev,
       @ARRAY@(rev - 1, rev - 2) as compatible
from {fx_nodes} where not (application % 13 = 5 and rev % 3 = 0)
union all
select application, 1, concat('t', cast(rev as string)), rev, @ARRAY@(rev - 1)
from {fx_nodes} where application % 13 = 7 and rev % 4 = 0
union all
select application, 2, concat('u', cast(rev as string)), rev, @ARRAY@(rev - 1, rev - 2)
from {fx_nodes} where application % 2 = 0
""")

_view("fx_settings_scripts", ("fx_settings_entries",), """
select application, cluster_no, migration_id, 'main' as upgrade_type, 1 as pos,
       concat(migration_id, '-settings.sql') as script
from {fx_settings_entries}
union all
select application, cluster_no, migration_id, 'replica', 1, concat(migration_id, '-replica-settings.sql')
from {fx_settings_entries} where to_rev % 2 = 0
""")

# what the hosts of the fleet have stored: a var and a func row each, but for
# hosts that were never installed
_view("fx_fleet_history", ("fx_fleet",), """
select cast(application * 20 + cast(right(host_id, 1) as bigint) * 2 as bigint) as revision_history_id,
       host_id, group_type as schemas_type, 'var' as kind, cast('2024-01-02 00:00:00' as @TS_NTZ@) as datetime,
       from_rev as revision, 'installed' as comment, @ARRAY@('old_var', 'old') as schemas
from {fx_fleet} where application % 11 <> 0
union all
select cast(application * 20 + cast(right(host_id, 1) as bigint) * 2 + 1 as bigint),
       host_id, group_type, 'func', cast('2024-01-02 00:00:00' as @TS_NTZ@),
       from_rev, 'installed', @ARRAY@('old_func')
from {fx_fleet} where application % 11 <> 0
""")


#: views that many others of a query read: a window over a whole table that is
#: computed and written once instead of once a reader
SHARED = ("fx_nodes", "fx_fleet")


def _dialect(sql: str, dialect: str) -> str:
    for token, value in DIALECT[dialect].items():
        sql = sql.replace(token, value)
    return sql


class Fixtures:
    """Builds fixture DataFrames for one scale-factor folder (memoised)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in TABLES:
                self._frames[name] = read_table(self.spark, self.sf_dir, name)
            else:
                sql, deps = VIEWS[name]
                frames = {d: self[d] for d in deps}
                frame = self.spark.sql(_dialect(sql, "spark"), **frames)
                self._frames[name] = written(frame, name) if name in SHARED else frame
        return self._frames[name]


def view_over(spark: SparkSession, name: str, **frames: DataFrame) -> DataFrame:
    """Fixture view ``name`` over the given frames (streaming ones too)."""
    return spark.sql(_dialect(VIEWS[name][0], "spark"), **frames)


def _closure(names) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in TABLES or n in order:
            return
        for d in VIEWS[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def duckdb_sql(query: str, uses: tuple[str, ...]) -> str:
    """Prefix ``query`` with the fixture views it uses as DuckDB CTEs.

    ``query`` names tables and views as ``{name}`` like the fixture SQL."""
    names = _closure(uses)
    ctes = [f"{n} as ({_dialect(VIEWS[n][0], 'duckdb')})" for n in names]
    ident = {n: n for n in list(VIEWS) + list(TABLES)}
    body = _dialect(query.strip(), "duckdb")
    head = "with "
    rec = re.match(r"(?i)with\s+recursive\s+", body)
    plain = re.match(r"(?i)with\s+", body)
    if rec:
        head, body = "with recursive ", body[rec.end():]
        ctes.append("")
    elif plain:
        body = body[plain.end():]
        ctes.append("")
    if not ctes:
        return body.format(**ident)
    joined = ",\n".join(ctes)
    text = head + (joined + body if joined.endswith(",\n") else joined + "\n" + body)
    return text.format(**ident)
