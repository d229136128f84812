"""Queries over scalar functions (FN1 to FN27)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import render as r
from ..registry import Tables, query
from ..sources import json_text


@query(r"""select doc_id, regexp_extract(source, '[0-9]+$') token, try_cast(regexp_extract(source, '^src(0|[1-9][0-9]*)$', 1) as decimal(38,0))::bigint v from documents""")
def fn_parse(t: Tables) -> DataFrame:
    token = F.regexp_extract("source", "[0-9]+$", 0)
    return t("documents").select("doc_id", token.alias("token"), r.parse(token, "integer").cast("long").alias("v"))


@query("""select s_suppkey, abs(s_acctbal) v from supplier""")
def fn_magnitude(t: Tables) -> DataFrame:
    return t("supplier").select("s_suppkey", F.abs("s_acctbal").alias("v"))


@query("""select o_orderkey, cast(cast(cast(o_totalprice as decimal(18,4)) * 0.001 as decimal(30,7)) as varchar) v from orders""")
def fn_scale(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", r.scaled(F.col("o_totalprice").cast("decimal(18,4)"), "0.001").cast("decimal(30,7)").cast("string").alias("v"))


@query("""select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(round_even(cast(l_extendedprice * 100 as decimal(20,0)) / 1000, 0) as bigint) v from lineitem""")
def fn_round_half_even(t: Tables) -> DataFrame:
    tens = r.half_even(F.col("l_extendedprice"), -1).cast("long") / 10
    return t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", tens.cast("long").alias("v"))


@query("""select p_partkey, format('{:.2f}', p_retailprice / 2) v from part""")
def fn_fixed(t: Tables) -> DataFrame:
    """Halves of cents: ties as printed, but mostly not in binary."""
    return t("part").select("p_partkey", r.fixed(F.col("p_retailprice") / 2, 2).alias("v"))


@query("""select p_partkey, cast(case when p_retailprice >= 999.5 then cast(round_even(cast(p_retailprice as decimal(20,2)) / 10, 0) as bigint) * 10 else cast(round_even(cast(p_retailprice as decimal(20,2)), 0) as bigint) end as varchar) v from part""")
def fn_significant(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", r.significant(F.col("p_retailprice"), 3).alias("v"))


@query(r"""select o_orderkey, replace(regexp_replace(format('{:.2e}', o_totalprice), 'e\+0?', 'e'), 'e-0', 'e-') v from orders""")
def fn_scientific(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", r.scientific(F.col("o_totalprice"), 3).alias("v"))


@query("""select o_orderkey, format('{:,}', o_custkey * 1000) v from orders""")
def fn_grouped_integer(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", r.grouped(F.col("o_custkey") * 1000).alias("v"))


@query("""select s_suppkey, case when s_acctbal < 0 then '' else '+' end || cast(cast(s_acctbal as decimal(20,2)) as varchar) v from supplier""")
def fn_sign(t: Tables) -> DataFrame:
    return t("supplier").select("s_suppkey", r.signed(F.col("s_acctbal"), r.fixed(F.col("s_acctbal"), 2)).alias("v"))


@query("""select cast(cast(l_discount * 100 as decimal(20,1)) as varchar) || '%' v, count(*) n from lineitem group by 1""")
def fn_percentage(t: Tables) -> DataFrame:
    return t("lineitem").groupBy(r.percentage(F.col("l_discount")).alias("v")).agg(F.count("*").alias("n"))


@query("""select doc_id, case when quality = 1 then 'Pass' else 'Fail' end a, case when toxic = 1 then 'yes' else 'no' end b from labels""")
def fn_boolean_style(t: Tables) -> DataFrame:
    return t("labels").select("doc_id", r.boolean(F.col("quality") == 1, "pass_fail").alias("a"), r.boolean(F.col("toxic") == 1, "yes_no").alias("b"))


@query("""select p_partkey, p_size || ' mm' a, p_size || '%' b, p_size || '°C' c from part""")
def fn_unit(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    return t("part").select("p_partkey", r.with_unit(size, "mm").alias("a"), r.with_unit(size, "%").alias("b"), r.with_unit(size, "°C").alias("c"))


@query("""with s as (select p_brand, cast(cast(min(p_retailprice) as decimal(20,2)) as varchar) a, cast(cast(max(p_retailprice) as decimal(20,2)) as varchar) b from part group by 1)
select p_brand, a || '–' || b spelled_range, a || ' ± ' || b spelled_pm, a || ' +/- ' || b spelled_pm_ascii, a || ' [' || a || ', ' || b || '] USD' spelled_interval, '(' || a || ', ' || b || ')' spelled_tuple from s""")
def fn_forms(t: Tables) -> DataFrame:
    s = t("part").groupBy("p_brand").agg(r.fixed(F.min("p_retailprice"), 2).alias("a"), r.fixed(F.max("p_retailprice"), 2).alias("b"))
    a, b = F.col("a"), F.col("b")
    return s.select(
        "p_brand", r.forms([a, b], "range")[0].alias("spelled_range"), r.forms([a, b], "plus_minus")[0].alias("spelled_pm"),
        r.forms([a, b], "plus_minus")[1].alias("spelled_pm_ascii"),
        r.forms([a, a, b], "interval", "USD")[0].alias("spelled_interval"), r.forms([a, b], "tuple")[0].alias("spelled_tuple"),
    )


@query("""select p_partkey, rtrim(rtrim(format('{:.80f}', p_retailprice / 7), '0'), '.') v from part""")
def fn_exact_float(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", r.exact_float(F.col("p_retailprice") / 7).alias("v"))


@query("""select o_orderkey, o_orderkey || ':' || o_orderstatus v from orders""")
def fn_identity_text(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("v"))


@query("""select s_suppkey, '| ' || s_name || ' | ' || cast(cast(s_acctbal as decimal(20,1)) as varchar) || ' |' line from (select s_suppkey, s_name, round_even(cast(s_acctbal as decimal(20,2)), 1) s_acctbal from supplier)""")
def render_table(t: Tables) -> DataFrame:
    columns = [F.col("s_name"), r.fixed(F.col("s_acctbal").cast("decimal(20,2)"), 1)]
    return t("supplier").select("s_suppkey", F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |")).alias("line"))


@query("""select n_nationkey, '{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}' v from nation""")
def fn_canonical_json(t: Tables) -> DataFrame:
    return t("nation").select("n_nationkey", r.canonical_json({"region": F.col("n_regionkey"), "name": F.col("n_name"), "key": F.col("n_nationkey")}).alias("v"))


@query("""select doc_id, sha256(text) v from documents where text is not null""")
def fn_sha256(t: Tables) -> DataFrame:
    return t("documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("v"))


@query(r"""with w as (select doc_id, unnest(string_split(text, ' ')) w from documents where doc_id is not null)
select case when w = '' then 'null' when lower(w) in ('true', 'false') then 'boolean' when regexp_matches(w, '^[+-]?(0|[1-9][0-9]*)$') then 'integer' when regexp_matches(w, '(?i)^[+-]?(([0-9]+\.[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|[0-9]+e[+-]?[0-9]+|inf(inity)?|nan)$') then 'float' else 'text' end kind, count(*) n from w group by 1""")
def fn_infer_type(t: Tables) -> DataFrame:
    words = t("documents").where("text is not null").select(F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy(r.cell_type(F.col("w")).alias("kind")).agg(F.count("*").alias("n"))


@query(r"""with w as (select unnest(string_split(text, ' ')) w from documents)
select w token, count(*) n from (select w, regexp_replace(w, '^\s+|\s+$', '', 'g') x from w)
where regexp_matches(x, '(^|[^A-Za-z0-9_])[-+]?([0-9]|\.[0-9])') and regexp_matches(x, '^[\s~≈<>≤≥(\[{]*[-+]?([0-9]|\.[0-9])') and not regexp_matches(x, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') and not regexp_matches(x, '^--') and not regexp_matches(x, '(?i)^[0-9]+\s*PH(\b|$)')
and not regexp_matches(x, '[A-Za-z_][A-Za-z0-9_.-]*\s*=') and not regexp_matches(x, '^[0-9a-fA-F]{12,}$') and not regexp_matches(x, '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$') group by 1""")
def fn_numeric_expression(t: Tables) -> DataFrame:
    words = t("documents").select(F.explode(F.split("text", " ")).alias("token"))
    return words.where(r.numeric_expression(F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))


@query("""select event_id, cast(json_extract(props, '$.k') as bigint) k from events""")
def fn_extract_json(t: Tables) -> DataFrame:
    chatty = F.concat(F.lit("Sure, here it is:\n"), F.col("props"), F.lit("\nDone."))
    parsed = F.coalesce(F.try_parse_json(chatty), F.try_parse_json(F.regexp_extract(chatty, r"(?s)\{.*\}", 0)))
    return t("events").select("event_id", F.try_variant_get(parsed, "$.k", "bigint").alias("k"))


NESTED = """json_object('a', role, 'l', json_array(json_object('b', text), json_object('n', turn, 'b', 'x')), 'z', json_object('y', json_object('x', json_array(role, null))))"""


@query(f"""with j as (select conv_id, turn, {NESTED} j from conversations) select conv_id, turn, list(json_extract_string(t.atom, '$') order by t.id) strings from j, lateral (select * from json_tree(j.j)) t where t.type = 'VARCHAR' group by 1, 2""")
def fn_collect_strings(t: Tables) -> DataFrame:
    """All strings of the turns of conversations as nested JSON, in order."""
    x = lambda **c: F.struct(*(v.alias(k) for k, v in c.items()))
    inner = F.array(x(b=F.col("text"), n=F.lit(None).cast("long")), x(b=F.lit("x"), n=F.col("turn")))
    nested = F.to_json(x(a=F.col("role"), l=inner, z=x(y=x(x=F.array("role", F.lit(None).cast("string"))))))
    return json_text.json_strings(t("conversations").select("conv_id", "turn", nested.alias("j")), "j", "conv_id", "turn")


@query("""select o_orderkey, coalesce(strftime(o_orderdate, '%b %-d'), '—') v from orders""")
def fn_date_text(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", F.coalesce(F.date_format("o_orderdate", "MMM d"), F.lit("—")).alias("v"))


@query("""select doc_id, text[1:1024] head, length(text)::bigint "length", length(text) > 1024 cut from documents""")
def fn_preview(t: Tables) -> DataFrame:
    p = t("documents").select("doc_id", r.preview(F.col("text")).alias("p"))
    return p.select("doc_id", "p.head", F.col("p.length").cast("long").alias("length"), "p.cut")


@query("""select o_orderkey, case when o_orderstatus = 'F' and o_totalprice > 100000 then 'failed' when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'P' then 'blocked' else 'not_run' end v from orders""")
def fn_classify_command(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    v = F.when((s == "F") & (F.col("o_totalprice") > 100000), "failed").when(s == "F", "completed").when(s == "P", "blocked").otherwise("not_run")
    return t("orders").select("o_orderkey", v.alias("v"))


@query("""select l_returnflag, l_linestatus, case when l_returnflag = 'R' then 'changed' when l_linestatus = 'F' then 'matched' else 'unavailable' end v, count(*) n from lineitem group by 1, 2, 3""")
def fn_classify_artifact(t: Tables) -> DataFrame:
    v = F.when(F.col("l_returnflag") == "R", "changed").when(F.col("l_linestatus") == "F", "matched").otherwise("unavailable")
    return t("lineitem").groupBy("l_returnflag", "l_linestatus", v.alias("v")).agg(F.count("*").alias("n"))
