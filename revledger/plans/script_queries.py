"""Script-corpus queries over fx_scripts / fx_files / fx_pins / fx_includes."""

from __future__ import annotations

from pyspark.sql import functions as F

from revledger.functions.keys import file_safe_key
from revledger.functions.lists import as_list
from revledger.operators import scripts
from revledger.operators.sequence import number_rows
from revledger.plans.fixtures import view_over
from revledger.plans.registry import query
from revledger.session import written
from revledger.sources.scripts import (bundle_keys, keep_suffix, scan_scripts, write_bundles,
                                       write_scripts)
from revledger.streaming.ledger_stream import scratch

# the include-reference pattern, braces doubled for the SQL template
_REF = r"^(\$\{([A-Za-z0-9_]+)\}|\$([A-Za-z0-9_]+))(.*)$".replace("{", "{{").replace("}", "}}")


def _script_files(fx):
    """``fx_script_files``. Where no document has two labels, the planner is
    told so: the join then repeats no row, a file holds nothing of a label,
    and the planner drops it, so that no text is shuffled."""
    labels = fx["labels"]
    named = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count()
    if not named.filter("count > 1").isEmpty():
        return fx["fx_script_files"]
    docs = view_over(fx.spark, "fx_scripts", documents=fx["documents"], labels=labels.dropDuplicates(["doc_id"]))
    return view_over(fx.spark, "fx_script_files", fx_scripts=docs)


def _scanned(fx, order=None):
    """The corpus written as files under a new folder and scanned."""
    root = scratch(fx.spark, "scripts v1+x")
    write_scripts(_script_files(fx), root).write.format("noop").mode("overwrite").save()
    return scan_scripts(fx.spark, [root], order=order)


@query("script_scan", ("fx_script_files",), """
select path, cast(length(text) as bigint) as n_chars, md5(text) as digest
from {fx_script_files} where path like '%.sql'
""")
def script_scan(fx):
    """Scripts scanned from files by their suffix, whole and under their
    relative path (S3, P4)."""
    s = keep_suffix(_scanned(fx))
    return s.select("path", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query("script_bundle", ("fx_script_files",), """
select replace(replace(split_part(path, '/', 1), '/', '-'), '.', '-') as host_key,
       replace(replace(split_part(path, '/', 2), '/', '-'), '.', '-') as type_key,
       cast(row_number() over (partition by split_part(path, '/', 1), split_part(path, '/', 2)
                               order by path) as bigint) as seq,
       path, cast(length(text) as bigint) as n_chars, md5(text) as digest
from {fx_script_files} where path like '%.sql'
""")
def script_bundle(fx):
    """Scanned scripts written as bundles per (host, type) in path order and
    read back in the order of the files (S4, F2). A line of a bundle is a whole
    script with its path, as JSON; digests are of the texts that were read."""
    host, kind = (F.split_part("path", F.lit("/"), F.lit(i)) for i in (1, 2))
    # paths are dealt in the order of the bundles before the texts are read
    s = _scanned(fx, [file_safe_key(host), file_safe_key(kind), F.col("path")])
    s = bundle_keys(s, host, kind)
    out = scratch(fx.spark, "bundles")
    write_bundles(s.select("host_key", "type_key", F.col("path").alias("seq"),
                           F.to_json(F.struct("path", "text")).alias("text")), out, dealt=True)
    back = fx.spark.read.schema("value string, host_key string, type_key string").text(out)
    script = F.from_json("value", "path string, text string")
    back = back.select("host_key", "type_key", script.alias("_s"),
                       F.col("_metadata.file_name").alias("_name"),
                       F.col("_metadata.file_block_start").alias("_at"),
                       F.monotonically_increasing_id().alias("_line"))
    # line numbers are fixed before they are sorted by
    back = written(back.select("host_key", "type_key", "_s.path", F.length("_s.text").cast("bigint").alias("n_chars"),
                               F.md5("_s.text").alias("digest"), "_name", "_at", "_line"), "bundles")
    out = number_rows(back, ["host_key", "type_key"], ["_name", "_at", "_line"], "seq")
    return out.select("host_key", "type_key", "seq", "path", "n_chars", "digest")


_PINS = """
with pa as (select grp, name, min(case when which = 'first' then pin_pos end) as fp,
                   min(case when which = 'last' then pin_pos end) as lp
            from {fx_pins} group by grp, name)
"""


@query("pinned_order", ("fx_files", "fx_pins", "fx_inline"), _PINS + """
select grp, dir, name, bucket,
       cast(row_number() over (partition by grp order by bucket, pin_key, dir_pos, name) as bigint) as seq
from (select f.grp, f.dir, f.dir_pos, f.name,
             case when pa.fp is not null then 0 when pa.lp is not null then 3 else 1 end as bucket,
             coalesce(pa.fp, pa.lp, 0) as pin_key
      from {fx_files} f left join pa on pa.grp = f.grp and pa.name = f.name
      union all
      select grp, dir, dir_pos, name, 2, 0 from {fx_inline}) o
""")
def pinned_order(fx):
    """Install order of every file and inline script of every include group (O1)."""
    o = scripts.pinned_order(fx["fx_files"], fx["fx_pins"], fx["fx_inline"])
    return o.select("grp", "dir", "name", "bucket", "seq")


@query("path_duplicates", ("fx_listed_files",), """
select grp, path, count(*) as n, min(dir_pos) as first_dir, max(dir_pos) as last_dir
from {fx_listed_files} group by grp, path having count(*) > 1
""")
def path_duplicates(fx):
    """Files that a group's include directories list more than once (O1 error case)."""
    return scripts.duplicate_paths(fx["fx_listed_files"])


@query("pin_unmatched", ("fx_files", "fx_pins"), """
select p.grp, p.name, p.which, p.pin_pos, 'not_found' as reason from {fx_pins} p
where not exists (select 1 from {fx_files} f where f.grp = p.grp and f.name = p.name)
union all
select p.grp, p.name, p.which, p.pin_pos, 'shadowed' from {fx_pins} p
where exists (select 1 from {fx_files} f where f.grp = p.grp and f.name = p.name)
  and exists (select 1 from {fx_pins} q where q.grp = p.grp and q.name = p.name
              and ((case when q.which = 'first' then 0 else 1 end)
                     < (case when p.which = 'first' then 0 else 1 end)
                   or (q.which = p.which and q.pin_pos < p.pin_pos)))
""")
def pin_unmatched(fx):
    """Pins that take no file (O1 error case)."""
    u = scripts.unused_pins(fx["fx_files"], fx["fx_pins"])
    return u.select("grp", "name", "which", "pin_pos", "reason")


@query("include_refs", ("fx_includes", "fx_include_refs"), f"""
with x as (select file_id, include,
                  case when regexp_matches(include, '(?s){_REF}')
                       then coalesce(nullif(regexp_extract(include, '(?s){_REF}', 2), ''),
                                     regexp_extract(include, '(?s){_REF}', 3)) end as ref_name,
                  regexp_extract(include, '(?s){_REF}', 4) as rest
           from {{fx_includes}})
select x.file_id, x.include, x.ref_name,
       case when x.ref_name is null then x.include
            when r.ref_name is not null then r.ref_value || x.rest end as resolved,
       case when x.ref_name is null then 'plain' when r.ref_name is null then 'undefined'
            else 'resolved' end as status
from x left join {{fx_include_refs}} r on r.ref_name = x.ref_name
""")
def include_refs(fx):
    """Leading include references resolved against the reference map."""
    r = scripts.resolve_refs(fx["fx_includes"], fx["fx_include_refs"])
    return r.select("file_id", "include", "ref_name", "resolved", "status")


@query("root_violations", ("fx_scripts", "fx_roots"), """
select f.file_id, f.path from {fx_scripts} f
where not exists (select 1 from {fx_roots} r
                  where f.path = rtrim(r.root, '/') or starts_with(f.path, rtrim(r.root, '/') || '/'))
""")
def root_violations(fx):
    """Files outside every allowed root, by path component (P5)."""
    v = scripts.outside_roots(fx["fx_scripts"].select("file_id", "path"), fx["fx_roots"])
    return v.select("file_id", "path")


@query("entry_kind", ("fx_scripts",), """
select dir, lang,
       case when has_init then 'init' when has_schema then 'schema' when has_late then 'late'
            when has_safeguard then 'safeguard' end as kind
from (select dir, split_part(path, '/', 2) as lang,
             bool_or(file_path_type = 'first') as has_init,
             bool_or(file_path_type = 'regular' and path like '%.sql') as has_schema,
             bool_or(file_path_type = 'last') as has_late,
             bool_or(path like '%.txt') as has_safeguard
      from {fx_scripts} group by dir, split_part(path, '/', 2)) x
""")
def entry_kind(fx):
    """Directory kind by first marker present: init > schema > late > safeguard."""
    s = fx["fx_scripts"].withColumn("lang", F.split_part("path", F.lit("/"), F.lit(2)))
    flags = s.groupBy("dir", "lang").agg(
        F.bool_or(F.col("file_path_type") == "first").alias("has_init"),
        F.bool_or((F.col("file_path_type") == "regular") & F.col("path").endswith(".sql"))
        .alias("has_schema"),
        F.bool_or(F.col("file_path_type") == "last").alias("has_late"),
        F.bool_or(F.col("path").endswith(".txt")).alias("has_safeguard"))
    return scripts.entry_kinds(flags).select("dir", "lang", "kind")


@query("list_normalise", ("fx_list_fields",), """
select page_id, cast(len(l) as bigint) as n_items, array_to_string(l, '|') as items
from (select page_id,
             case when field is null then null
                  when ltrim(field) like '[%' and json_valid(field) then from_json(field, '["VARCHAR"]')
                  else [field] end as l
      from {fx_list_fields}) x
""")
def list_normalise(fx):
    """A field holding one string or a JSON list of strings, as a list."""
    f = fx["fx_list_fields"].withColumn("l", as_list("field"))
    return f.select("page_id",
                    F.when(F.col("l").isNotNull(), F.size("l")).cast("bigint").alias("n_items"),
                    F.array_join("l", "|").alias("items"))
