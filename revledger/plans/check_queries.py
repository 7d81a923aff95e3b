"""Integrity-check and drop queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from revledger.operators import checks, drops
from revledger.plans.registry import query


@query("check_unique", ("lineitem",), """
select l_orderkey, l_linenumber, count(*) as n from {lineitem}
group by l_orderkey, l_linenumber having count(*) > 1
""")
def check_unique(fx):
    """Keys that occur more than once (A1)."""
    return checks.unique(fx["lineitem"], ["l_orderkey", "l_linenumber"])


@query("check_at_most_one", ("fx_scripts",), """
select dir, count(*) filter (where file_path_type = 'first') as n, 'first' as rule
from {fx_scripts} group by dir having count(*) filter (where file_path_type = 'first') > 1
union all
select dir, count(*) filter (where file_path_type = 'last'), 'last'
from {fx_scripts} group by dir having count(*) filter (where file_path_type = 'last') > 1
""")
def check_at_most_one(fx):
    """Directories holding more than one 'first' or more than one 'last' file (A2)."""
    s = fx["fx_scripts"]
    a = checks.at_most_one(s, ["dir"], F.col("file_path_type") == "first", "first")
    b = checks.at_most_one(s, ["dir"], F.col("file_path_type") == "last", "last")
    return a.unionByName(b).select("dir", "n", "rule")


@query("check_domain", ("fx_schemas",), """
select schema_key, 'kind_domain' as rule from {fx_schemas} where kind not in ('var', 'func')
union all
select schema_key, 'name_required' from {fx_schemas} where name is null
union all
select schema_key, 'owner_required' from {fx_schemas} where owner is null
union all
select schema_key, 'type_required' from {fx_schemas} where schemas_type is null
""")
def check_domain(fx):
    """Domain and required-field rules evaluated in one pass (A3)."""
    s = fx["fx_schemas"]
    rules = {
        "kind_domain": ~F.coalesce(F.col("kind").isin("var", "func"), F.lit(False)),
        "name_required": F.col("name").isNull(),
        "owner_required": F.col("owner").isNull(),
        "type_required": F.col("schemas_type").isNull(),
    }
    return checks.domain(s, ["schema_key"], rules)


@query("required_missing", ("fx_required", "fx_catalog"), """
select r.object_id from {fx_required} r
where not exists (select 1 from {fx_catalog} c where c.object_id = r.object_id)
""")
def required_missing(fx):
    """Required objects absent from the catalog."""
    return drops.missing_required(fx["fx_required"], fx["fx_catalog"])


@query("drop_targets", ("fx_recorded", "fx_declared"), """
select application, unnest(schemas) as schema_name from {fx_recorded}
union
select application, unnest(schemas) from {fx_declared}
""")
def drop_targets(fx):
    """Recorded and declared schemas to drop per key, distinct."""
    return drops.drop_targets(fx["fx_recorded"], fx["fx_declared"], ["application"])


@query("drop_refusals", ("fx_schemas",), """
select schema_key, name, kind from {fx_schemas} where kind = 'var' and not schema_key % 5 = 0
""")
def drop_refusals(fx):
    """Var schemas whose drop is refused because cascade was not asked for."""
    k = F.col("schema_key")
    asked = F.when(k % 5 == 0, F.lit(True)).when(k % 5 == 1, F.lit(False))  # else not said
    targets = fx["fx_schemas"].withColumn("cascade", asked)
    return drops.cascade_refusals(targets).select("schema_key", "name", "kind")


@query("drop_routines", ("fx_recorded", "fx_declared", "fx_routines", "fx_versions"), """
with t as (select application, unnest(schemas) as schema_name from {fx_recorded}
           union
           select application, unnest(schemas) from {fx_declared})
select t.application, t.schema_name, r.routine_name, r.args,
       case when regexp_matches(v.server_version, '^PostgreSQL (8|9|10)\\.') then 'function'
            else 'routine' end as drop_kind
from t join {fx_routines} r on r.schema_name = t.schema_name
left join {fx_versions} v on v.application = t.application
""")
def drop_routines(fx):
    """Routines of the drop targets, drop word by server version."""
    t = drops.drop_targets(fx["fx_recorded"], fx["fx_declared"], ["application"])
    r = drops.drop_routines(t, fx["fx_routines"], fx["fx_versions"], ["application"])
    return r.select("application", "schema_name", "routine_name", "args", "drop_kind")
