"""Grant reconciliation.

Observed ACL items are classified against the grants a schema declares:
CREATE is expected for the owner; USAGE for the owner and every declared
grantee. An observed item is accepted only if its grantor is the owner,
it is not grantable and (schema, grantee, privilege) is expected;
anything else is unexpected (an error, or a notice in weak mode).
Expected items no observed item accepts are missing (always an error).
Everything is set-based: expected items are de-duplicated first, so an
owner that also appears in the grant list does not multiply rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revledger.operators.joins import maybe_broadcast


def expected_grants(declared: DataFrame, schema: str = "schema_key", owner: str = "owner",
                    grants: str = "grants") -> DataFrame:
    """(schema, owner, privilege, grantee) for every expected ACL item."""
    create = declared.select(F.col(schema), F.col(owner), F.lit("CREATE").alias("privilege"),
                             F.col(owner).alias("grantee"))
    usage_owner = declared.select(F.col(schema), F.col(owner), F.lit("USAGE").alias("privilege"),
                                  F.col(owner).alias("grantee"))
    usage_list = declared.select(F.col(schema), F.col(owner), F.lit("USAGE").alias("privilege"),
                                 F.explode(grants).alias("grantee"))
    return create.unionByName(usage_owner).unionByName(usage_list).distinct()


def _accept_on(obs: DataFrame, exp: DataFrame, schema: str):
    return ((obs[schema] == exp["_x_schema"]) & (obs["grantee"] == exp["_x_grantee"])
            & (obs["privilege"] == exp["_x_privilege"]) & (obs["grantor"] == exp["_x_owner"])
            & ~obs["is_grantable"])


def _renamed(exp: DataFrame, schema: str) -> DataFrame:
    return exp.select(F.col(schema).alias("_x_schema"), F.col("owner").alias("_x_owner"),
                      F.col("privilege").alias("_x_privilege"), F.col("grantee").alias("_x_grantee"))


def audit(observed: DataFrame, declared: DataFrame, weak: bool = False,
          schema: str = "schema_key") -> DataFrame:
    """Observed items with ``status`` (accepted / unexpected) and
    ``severity`` (NULL, or 'error' / 'notice' for unexpected ones)."""
    exp = _renamed(expected_grants(declared, schema), schema)
    j = observed.join(exp, _accept_on(observed, exp, schema), "left")
    accepted = F.col("_x_schema").isNotNull()
    return j.select(
        *[observed[c] for c in observed.columns],
        F.when(accepted, F.lit("accepted")).otherwise(F.lit("unexpected")).alias("status"),
        F.when(~accepted, F.lit("notice" if weak else "error")).alias("severity"))


def missing(observed: DataFrame, declared: DataFrame, schema: str = "schema_key") -> DataFrame:
    """Expected items that no observed item accepts."""
    exp = expected_grants(declared, schema)
    x = _renamed(exp, schema)
    hit = observed.select(F.col(schema).alias("_o_schema"), "grantor", "grantee", "privilege",
                          "is_grantable")
    cond = ((x["_x_schema"] == hit["_o_schema"]) & (x["_x_grantee"] == hit["grantee"])
            & (x["_x_privilege"] == hit["privilege"]) & (x["_x_owner"] == hit["grantor"])
            & ~hit["is_grantable"])
    left = x.join(hit, cond, "left_anti")
    return left.select(F.col("_x_schema").alias(schema), F.col("_x_privilege").alias("privilege"),
                       F.col("_x_grantee").alias("grantee"))


def acl_rows(acl: DataFrame, schema: str = "schema_key", owner: str = "owner",
             items: str = "acl") -> DataFrame:
    """Explode an ACL array column to observed items. A NULL ACL is first
    reset by 'revoke all from public', which leaves the owner's default
    USAGE and CREATE (granted by the owner, not grantable) (N15)."""
    item_t = acl.schema[items].dataType.simpleString()
    default = F.array(
        F.struct(F.col(owner).alias("grantor"), F.col(owner).alias("grantee"),
                 F.lit("USAGE").alias("privilege"), F.lit(False).alias("is_grantable")),
        F.struct(F.col(owner).alias("grantor"), F.col(owner).alias("grantee"),
                 F.lit("CREATE").alias("privilege"), F.lit(False).alias("is_grantable")),
    ).cast(item_t)
    filled = acl.select(F.col(schema), F.coalesce(F.col(items), default).alias("_items"))
    return filled.select(F.col(schema), F.inline("_items"))


def role_names(observed: DataFrame, roles: DataFrame, oid_cols=("grantor_oid", "grantee_oid"),
               oid: str = "oid", name: str = "rolname") -> DataFrame:
    """Role oid -> name: 0 is 'public', an unknown oid gives NULL."""
    out = observed
    small_roles = maybe_broadcast(roles.select(oid, name))
    for c in oid_cols:
        r = small_roles.select(F.col(oid).alias(f"_r_{c}"), F.col(name).alias(f"_n_{c}"))
        out = out.join(r, out[c] == r[f"_r_{c}"], "left")
        label = c[:-4] if c.endswith("_oid") else c + "_name"
        out = out.withColumn(label, F.when(F.col(c) == 0, F.lit("public"))
                             .otherwise(F.col(f"_n_{c}"))).drop(f"_r_{c}", f"_n_{c}")
    return out
