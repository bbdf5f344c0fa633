"""Queries of the translation bridge over stand-ins made of part, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import bridge
from glossweave.plans.queries import query, t

#: The stand-in dictionaries: which names of part each has, by a class of the name, c.
_DICTS = """part_c as (select *, (7 * length(p_name) + ascii(p_name)) % 12 as c from part),
 o as (select p_partkey as row, 'english' as s, 'mingrelian' as g, p_name as a, 'o ' || p_brand as b from part_c where c = 11 union all select p_partkey, 'russian', 'mingrelian', 'r ' || p_name, 'o ' || p_name from part_c where c = 10),
 pairs as (select p_partkey as row, 'm ' || p_name as m, p_name as e from part_c where c <= 2), gal as (select p_partkey as row, 'r ' || p_name as r, 'm ' || p_name as m from part_c where c between 2 and 5),
 kk as (select p_partkey as row, 'm ' || p_name || case when c = 6 then ' ' || p_size else '' end as m, 'r ' || p_name as r, 'k ' || p_name as k from part_c where c between 5 and 7),
 lex as (select p_partkey as row, 'h ' || case when c = 9 then p_brand else p_name end as h, 'm ' || p_name as w, p_name as e from part_c where c between 7 and 9),
 mem as (select 'english' as s, 'georgian' as g, p_name as a, 'k ' || p_name as b from part_c where c <> 4 union select 'english', 'russian', p_name, 'r ' || p_name from part_c where c <> 3 union select 'georgian', 'english', 'k ' || p_name, p_name from part_c where c <> 1
  union select 'georgian', 'russian', 'k ' || p_name, 'r ' || p_name from part_c where c <> 2 union select 'russian', 'english', 'r ' || p_name, p_name from part_c where c <> 3 union select 'russian', 'georgian', 'r ' || p_name, 'k ' || p_name from part_c where c <> 4),
 d as (select s, g, lower(a) as k, 0 as p, row, b as t from o union all select 'mingrelian', 'english', lower(m), 1, row, e from pairs union all select 'english', 'mingrelian', lower(e), 1, row, m from pairs union all select 'mingrelian', 'georgian', lower(m), 2, row, k from kk
  union all select 'georgian', 'mingrelian', lower(k), 2, row, m from kk union all select 'mingrelian', 'russian', lower(m), 3, row, r from gal union all select 'russian', 'mingrelian', lower(r), 3, row, m from gal),
 first as (select s, g, k, arg_min(t, p * 1000000000::bigint + row) as t from d group by all), mt as (select s, g, lower(a) as k, min(b) as t from mem group by all)"""

_TO = f"""with {_DICTS}, c as (select * from d where p = 0 union all select * from d where p in (1, 2) and (s, g, k) not in (select s, g, k from d where p = 0) union all select 'english', 'mingrelian', lower(e), 5, row, h from lex
  union all select distinct 'mingrelian', 'english', unnest([lower(h), lower(w)]), 5, row, e from lex),
 sole as (select s, g, k, arg_min(t, p * 1000000000::bigint + row) as t from c group by all having count(distinct lower(t)) = 1),
 r as (select distinct p_name as request_id, 'english' as s from part union select distinct 'k ' || p_name, 'georgian' from part),
 v as (select request_id, s as own, s, lower(request_id) as k, 0 as i from r union all select request_id, r.s, mt.g, lower(mt.t), case mt.g when 'russian' then 2 else 1 end from r join mt on mt.s = r.s and mt.k = lower(request_id)),
 h as (select request_id, 0 as o, 'direct' as leg, first.t from v join first using (s, k) where g = 'mingrelian' and i = 0 union all select request_id, 1 + 2 * i, case i when 0 then 'own' else v.s end || '_sole', sole.t from v join sole using (s, k) where g = 'mingrelian'
  union all select request_id, 2 + 2 * i, v.s || '_first', first.t from v join first using (s, k) where g = 'mingrelian' and i > 0)
 select request_id, arg_min(leg, o) as leg, arg_min(t, o) as answer from h group by 1"""

_FROM = f"""with {_DICTS}, a as (select lower(m) as k, 0 as p, row, e as t, 'english' as l from pairs union all select lower(e), 1, row, e, 'english' from pairs union all select lower(m), 2, row, r, 'russian' from gal union all select lower(r), 3, row, r, 'russian' from gal
  union all select lower(k), 5, row, k, 'georgian' from kk union all select lower(r), 6, row, r, 'russian' from kk),
 either as (select 'english' as g, * from a union all select 'georgian', * from a union all select 'english', lower(m), 4, row, r, 'russian' from kk union all select 'georgian', lower(m), 4, row, k, 'georgian' from kk),
 met as (select g, k, arg_min(t, p * 1000000000::bigint + row) as t, arg_min(l, p * 1000000000::bigint + row) as l from either group by all),
 w as (select distinct unnest(['m ' || p_name, 'r ' || p_name, upper(p_name)]) as word from part), r as (select word || '>' || g as request_id, word, g from w, (values ('english'), ('georgian')) x(g)),
 h as (select request_id, 0 as o, 'direct' as leg, first.t from r join first on s = 'mingrelian' and first.g = r.g and k = lower(word) union all select request_id, 1, 'same_language', t from r join met on met.g = r.g and k = lower(word) where l = r.g
  union all select request_id, 2, 'onward', mt.t from r join met on met.g = r.g and met.k = lower(word) join mt on mt.s = met.l and mt.g = r.g and mt.k = lower(met.t) where l <> r.g)
 select request_id, arg_min(leg, o) as leg, arg_min(t, o) as answer from h group by 1"""


def _lexica(s, d) -> bridge.Lexica:
    name, c = F.col("p_name"), F.col("c")
    part = t(s, d, "part").withColumn("row_id", F.col("p_partkey")).withColumn("c", (7 * F.length(name) + F.ascii(name)) % 12)
    with_ = lambda x, y: F.concat(F.lit(f"{x} "), y)
    m, r, k = (with_(x, name) for x in "mrk")
    own = lambda n, source, a, b: part.filter(c == n).select("row_id", F.lit(source).alias("source_language"), F.lit("mingrelian ").alias("target_language"), a.alias("source_text"), b.alias("target_text"))
    legs = [("english", "georgian", name, k, 4), ("english", "russian", name, r, 3), ("georgian", "english", k, name, 1), ("georgian", "russian", k, r, 2), ("russian", "english", r, name, 3), ("russian", "georgian", r, k, 4)]
    memory = F.array_compact(F.array(*[F.when(c != n, F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), x.alias("source_text"), y.alias("target_text"))) for a, b, x, y, n in legs]))
    return bridge.Lexica(
        own(11, "English", name, with_("o", "p_brand")).unionByName(own(10, "russian", r, with_("o", name))),
        part.filter(c <= 2).select("row_id", m.alias("mingrelian"), name.alias("english")),
        part.filter(c.between(2, 5)).select("row_id", r.alias("russian"), m.alias("mingrelian")),
        part.filter(c.between(5, 7)).select("row_id", F.when(c == 6, F.concat(m, F.lit(" "), "p_size")).otherwise(m).alias("mingrelian"), r.alias("russian"), k.alias("georgian")),
        part.filter(c.between(7, 9)).select("row_id", with_("h", F.when(c == 9, F.col("p_brand")).otherwise(name)).alias("headword"), m.alias("headword_raw"), name.alias("translation")),
        part.select(F.explode(memory).alias("x")).select("x.*"),
    )


@query("bridge_to_mingrelian", _TO)
def bridge_to_mingrelian(s, d):
    """Every name of part in English and Georgian; legs by dictionary, sole candidate and translation are all hit."""
    part = t(s, d, "part")
    ask = lambda c, source: part.select(c.alias("request_id"), c.alias("input_text"), F.lit(source).alias("source")).distinct()
    return bridge.to_mingrelian(ask(F.col("p_name"), "english").union(ask(F.concat(F.lit("k "), "p_name"), "georgian")), _lexica(s, d))


@query("bridge_from_mingrelian", _FROM)
def bridge_from_mingrelian(s, d):
    """Every name of part as a Mingrelian, a Russian and an English word, asked for in two languages."""
    words = t(s, d, "part").select(F.explode(F.array(F.concat(F.lit("m "), "p_name"), F.concat(F.lit("r "), "p_name"), F.upper("p_name"))).alias("input_text")).distinct()
    asked = words.select("input_text", F.explode(F.array(F.lit("english"), F.lit("georgian"))).alias("target"))
    return bridge.from_mingrelian(asked.withColumn("request_id", F.concat_ws(">", "input_text", "target")), _lexica(s, d))
