"""Grant reconciliation queries over fx_grants_declared / fx_grants_observed."""

from __future__ import annotations

from pyspark.sql import functions as F

from revledger.operators import grants
from revledger.plans.registry import query

_EXPECTED = """
with exp as (select schema_key, owner, 'CREATE' as privilege, owner as grantee from {fx_grants_declared}
             union
             select schema_key, owner, 'USAGE', owner from {fx_grants_declared}
             union
             select schema_key, owner, 'USAGE', unnest(grants) from {fx_grants_declared})
"""


@query("grant_audit", ("fx_grants_declared", "fx_grants_observed"), _EXPECTED + """
select o.schema_key, o.grantor, o.grantee, o.privilege, o.is_grantable,
       case when e.schema_key is not null then 'accepted' else 'unexpected' end as status,
       case when e.schema_key is null then 'error' end as severity
from {fx_grants_observed} o
left join exp e on e.schema_key = o.schema_key and e.grantee = o.grantee
               and e.privilege = o.privilege and o.grantor = e.owner and not o.is_grantable
""")
def grant_audit(fx):
    """Classify every observed ACL item as accepted or unexpected."""
    return grants.audit(fx["fx_grants_observed"], fx["fx_grants_declared"])


@query("grant_audit_weak", ("fx_grants_declared", "fx_grants_observed"), _EXPECTED + """
select o.schema_key, o.grantor, o.grantee, o.privilege, o.is_grantable,
       case when e.schema_key is not null then 'accepted' else 'unexpected' end as status,
       case when e.schema_key is null then 'notice' end as severity
from {fx_grants_observed} o
left join exp e on e.schema_key = o.schema_key and e.grantee = o.grantee
               and e.privilege = o.privilege and o.grantor = e.owner and not o.is_grantable
""")
def grant_audit_weak(fx):
    """The audit in weak mode: an unexpected item is a notice."""
    return grants.audit(fx["fx_grants_observed"], fx["fx_grants_declared"], weak=True)


@query("grant_acl_rows", ("fx_schemas",), """
select schema_key, owner as grantor, owner as grantee, p as privilege, false as is_grantable
from {fx_schemas}, (select unnest(['USAGE', 'CREATE']) as p) where schema_key % 4 = 0
union all
select schema_key, owner, concat('role_', cast(schema_key % 25 as string)), 'USAGE', schema_key % 3 = 0
from {fx_schemas} where schema_key % 4 <> 0
""")
def grant_acl_rows(fx):
    """ACL arrays as rows; a NULL ACL is reset to the owner's default items."""
    s, k = fx["fx_schemas"], F.col("schema_key")
    item = F.struct(F.col("owner").alias("grantor"),
                    F.concat(F.lit("role_"), (k % 25).cast("string")).alias("grantee"),
                    F.lit("USAGE").alias("privilege"), (k % 3 == 0).alias("is_grantable"))
    acl = s.select("schema_key", "owner", F.when(k % 4 != 0, F.array(item)).alias("acl"))
    return grants.acl_rows(acl)


@query("grant_missing", ("fx_grants_declared", "fx_grants_observed"), _EXPECTED + """
select e.schema_key, e.privilege, e.grantee from exp e
where not exists (select 1 from {fx_grants_observed} o
                  where o.schema_key = e.schema_key and o.grantee = e.grantee
                    and o.privilege = e.privilege and o.grantor = e.owner and not o.is_grantable)
""")
def grant_missing(fx):
    """Expected grants that no observed item satisfies."""
    return grants.missing(fx["fx_grants_observed"], fx["fx_grants_declared"])


@query("grant_role_names", ("fx_acl_oids", "fx_roles"), """
select a.schema_key, a.grantor_oid, a.grantee_oid, a.privilege,
       case when a.grantor_oid = 0 then 'public' else r1.rolname end as grantor,
       case when a.grantee_oid = 0 then 'public' else r2.rolname end as grantee
from {fx_acl_oids} a
left join {fx_roles} r1 on r1.oid = a.grantor_oid
left join {fx_roles} r2 on r2.oid = a.grantee_oid
""")
def grant_role_names(fx):
    """Role oids of ACL items resolved to names; 0 is public."""
    return grants.role_names(fx["fx_acl_oids"], fx["fx_roles"])
