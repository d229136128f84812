"""Queries over projections, filters and predicates (PF1 to PF13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import render
from ..registry import Tables, query


@query("""select e.event_id, cast(json_extract(props, '$.k') as bigint) k from events e""")
def path_project(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("""select vec_id, i - 1 pos, cast(embedding[i] as double) v from embeddings, range(3, 6) r(i)""")
def path_slice(t: Tables) -> DataFrame:
    part = t("embeddings").select("vec_id", F.posexplode(F.slice("embedding", 3, 3)).alias("p", "v"))
    return part.select("vec_id", (F.col("p") + 2).cast("long").alias("pos"), F.col("v").cast("double").alias("v"))


@query("""select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and not isnan(o_totalprice)""")
def where_eq_typed(t: Tables) -> DataFrame:
    return t("orders").where((F.col("o_orderstatus") == "F") & ~F.isnan("o_totalprice")).select("o_orderkey", "o_totalprice")


@query("""select l_returnflag, count(*) n from lineitem where l_linestatus = 'O' and l_returnflag in ('A', 'N') group by 1""")
def where_in(t: Tables) -> DataFrame:
    rows = t("lineitem").where((F.col("l_linestatus") == "O") & F.col("l_returnflag").isin(sorted({"N", "A", "N"})))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("""with p as (select doc_id, n_chars > 2000 a, try_cast(regexp_extract(source, '[0-9]+') as integer) > 5 b, try_cast(regexp_extract(source, '[0-9]+$') as integer) is null bad from documents)
select doc_id, coalesce(a and b, false) matched, bad parse_error from p""")
def where_all_checked(t: Tables) -> DataFrame:
    number = F.regexp_extract("source", "[0-9]+$", 0).try_cast("int")
    rows = t("documents").select("doc_id", (F.col("n_chars") > 2000).alias("a"), (number > 5).alias("b"), number.isNull().alias("bad"))
    return rows.select("doc_id", F.coalesce(F.col("a") & F.col("b"), F.lit(False)).alias("matched"), F.col("bad").alias("parse_error"))


@query(r"""with w as (select conv_id, turn, unnest(string_split(text, ' ')) w from conversations)
select conv_id, turn, count(*) words, count(case when regexp_matches(w, '^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$') then 1 end) numbers from w group by 1, 2""")
def parse_guarded(t: Tables) -> DataFrame:
    words = t("conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy("conv_id", "turn").agg(F.count("*").alias("words"), F.count_if(render.is_number(F.col("w"), "decimal")).alias("numbers"))


@query("""select s_suppkey record, 's_name' field, s_name "value" from supplier union all select s_suppkey, 's_nationkey', cast(s_nationkey as varchar) from supplier""")
def select_items_long(t: Tables) -> DataFrame:
    s = t("supplier").select(F.col("s_suppkey").alias("record"), "s_name", F.col("s_nationkey").cast("string").alias("s_nationkey"))
    return s.unpivot("record", ["s_name", "s_nationkey"], "field", "value")


@query("""select 'orders' "name", count(*) row_count, 6::bigint column_count from orders union all select 'nation', count(*), 3 from nation""")
def collection_properties(t: Tables) -> DataFrame:
    out = [t(n).agg(F.count("*").alias("row_count")).select(F.lit(n).alias("name"), "row_count", F.lit(len(t(n).columns)).cast("long").alias("column_count")) for n in ("orders", "nation")]
    return out[0].unionByName(out[1])


@query("""select vec_id, cast(len(embedding) as bigint) size, 'array<float>' dtype from embeddings""")
def value_properties(t: Tables) -> DataFrame:
    return t("embeddings").select("vec_id", F.size("embedding").cast("long").alias("size"), F.typeof("embedding").alias("dtype"))


@query("""select vec_id, i - 1 pos, i * 10 idx, cast(embedding[i] as double) v from embeddings, range(1, 65) r(i) where len(embedding) = 64""")
def align_arrays(t: Tables) -> DataFrame:
    """Components of vectors beside an index array, where both are of one length."""
    e = t("embeddings")
    e = e.withColumn("idx", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i * 10))
    e = e.where(F.size("idx") == F.size("embedding")).select("vec_id", F.posexplode(F.arrays_zip("idx", "embedding")).alias("pos", "z"))
    return e.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("z.idx").cast("long").alias("idx"), F.col("z.embedding").cast("double").alias("v"))


@query("""select event_id, k as "key", json_extract_string(props, '$.' || k) "value" from (select event_id, props, unnest(list_sort(json_keys(props))) k from events)""")
def expand_map_sorted(t: Tables) -> DataFrame:
    m = t("events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    m = m.select("event_id", "m", F.posexplode(F.array_sort(F.map_keys("m"))).alias("pos", "key"))
    return m.select("event_id", "key", F.col("m")[F.col("key")].alias("value"))


@query("""select o_orderkey from orders where o_orderstatus = 'O' and o_orderpriority = '1-URGENT'""")
def list_filtered(t: Tables) -> DataFrame:
    wanted = {"o_orderstatus": "O", "o_orderpriority": "1-URGENT", "o_custkey": None}
    rows = t("orders")
    for name, value in wanted.items():
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows.select("o_orderkey")


@query("""select o_orderkey from orders o where o_orderstatus = 'P' and exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l_returnflag = 'R')""")
def filter_or_exists(t: Tables) -> DataFrame:
    label = "P"
    if label not in ("F", "O", "P"):
        raise ValueError(label)
    returned = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").where(F.col("o_orderstatus") == label).join(returned, "o_orderkey", "left_semi").select("o_orderkey")
