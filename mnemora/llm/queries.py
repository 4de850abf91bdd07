"""The queries op1_… to op13_…, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm import bpe, chat, crf, knn, langid, linededup, mixing, neardup, packing, pareto, rules, spelling, warc
from mnemora.llm._shared import written

#: Mixing: words of budget as a multiple of all words, epochs at most, and weights by level.
MIX_LEVELS = ("domain", "lang", "source")
MIX_WEIGHTS = [{"d0": 4, "d1": 3, "d2": 2, "d3": 1}, {"en": 5, "de": 2, "fr": 2, "es": 2}, {}]
MIX_EPOCHS, MIX_SEED = 2, 20240131


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain(source: Column) -> Column:
    """Four domains by the number at a source's end."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("int") % 4, F.lit(0)))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


def op2_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = chat.conversations(_table(spark, sf_dir, "conversations"), escape=True)
    pairs = chat.preference_pairs(convs, chat.swapped_answers(convs))
    return pairs.withColumns({c: chat.span_text(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    levels = dict(zip(MIX_LEVELS, (domain(F.col("source")), F.col("lang"), F.col("source"))))
    return mixing.mix(docs, levels, MIX_WEIGHTS, F.sum("tokens"), MIX_EPOCHS, MIX_SEED)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(_table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return knn.top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(_table(spark, sf_dir, "documents"))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule rejects, and rejects alone, under each version of the policy, from one ledger."""
    rows = written(rules.ledger(_table(spark, sf_dir, "documents")), "ledger")
    out = [rules.ablations(rows, policy).select(F.lit(policy).alias("policy"), "rule", "n_failed", "n_only") for policy in rules.POLICIES]
    return reduce(DataFrame.unionByName, out)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.broadcast_vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return crf.score(docs, crf.learn(docs, _table(spark, sf_dir, "labels")))


def op11_pareto_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.layered_offers(*(_table(spark, sf_dir, name) for name in ("sale_lines", "items", "sales")))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.broadcast_vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    return packing.packed(_table(spark, sf_dir, "documents"), vocabulary, ids=False)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_chat_preference, op3_mixing, op4_line_dedup, op5_near_dedup, op6_top_k, op7_quality_rules, op8_bpe, op9_warc, op10_quality,
        op11_pareto_layers, op12_packing, op13_spelling,
    )
}

#: Further results of the ten operators, beside their one query each.
MORE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"rule_ablations": rule_ablations}

_SPACES = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_CHAT_SQL = """
with t as (select distinct conv_id, turn, replace(replace(coalesce(role, ''), '<\\', '<\\\\'), '<|', '<\\|') as role, replace(replace(coalesce(text, ''), '<\\', '<\\\\'), '<|', '<\\|') as text from conversations where conv_id is not null),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from t),
l as (select conv_id, max(i) filter (where role = 'assistant') as last from n group by conv_id),
a as (select xor(n.conv_id, 1) as conv_id, n.text as other from n join l on n.conv_id = l.conv_id and n.i = l.last),
r as (select n.conv_id, n.i, n.role, n.text, case when n.i = l.last then coalesce(a.other, '') else n.text end as swapped
      from n join l using (conv_id) left join a using (conv_id)),
p as (select conv_id, coalesce(min(i) filter (where text <> swapped) - 1, max(i)) as prompt from r group by conv_id),
x as (select r.conv_id, r.i, r.role, p.prompt, r.i <= p.prompt as shared,
        '<|' || r.role || '|>' || chr(10) || r.text || '<|end|>' || chr(10) as c,
        '<|' || r.role || '|>' || chr(10) || r.swapped || '<|end|>' || chr(10) as s
      from r join p using (conv_id)),
y as (select *, coalesce(sum(length(c)) over w, 0) as c_at, coalesce(sum(length(s)) over w, 0) as s_at
      from x window w as (partition by conv_id, shared order by i rows between unbounded preceding and 1 preceding))
select conv_id as pair_id, max(prompt)::bigint as n_prompt_turns,
  coalesce(string_agg(c, '' order by i) filter (where shared), '') as prompt,
  coalesce(string_agg(c, '' order by i) filter (where not shared), '') as chosen,
  coalesce(string_agg(s, '' order by i) filter (where not shared), '') as rejected,
  coalesce(string_agg((c_at + 5 + length(role))::bigint || '-' || (c_at + length(c))::bigint, ',' order by i) filter (where not shared and role = 'assistant'), '') as chosen_spans,
  coalesce(string_agg((s_at + 5 + length(role))::bigint || '-' || (s_at + length(s))::bigint, ',' order by i) filter (where not shared and role = 'assistant'), '') as rejected_spans
from y group by conv_id
"""


def _mix_sql() -> str:
    """Shares and prefixes by plain windows over whole leaves."""
    steps = [
        "slim as (select doc_id, 'd' || coalesce(try_cast(regexp_extract(coalesce(source, ''), '(\\d{1,9})$', 1) as int) % 4, 0) as domain, coalesce(lang, '') as lang, coalesce(source, '') as source, "
        "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as tokens from documents)",
        "leaves as (select domain, lang, source, sum(tokens)::hugeint as tokens, count(*) as n from slim group by all)",
        f"g0 as (select least(sum(tokens), sum(tokens * {MIX_EPOCHS})) as total from leaves)",
    ]
    for i, name in enumerate(MIX_LEVELS):
        path, parent = ", ".join(MIX_LEVELS[: i + 1]), ", ".join(MIX_LEVELS[:i])
        weight = "case " + name + "".join(f" when '{k}' then {v}" for k, v in MIX_WEIGHTS[i].items()) + " else 1 end" if MIX_WEIGHTS[i] else "1"
        part = f"partition by {parent} " if parent else ""
        steps += [
            f"n{i} as (select {path}, sum(tokens * {MIX_EPOCHS})::hugeint as cap, ({weight})::hugeint as weight from leaves group by {path})",
            f"o{i} as (select n.*, g.total::hugeint as total from n{i} n " + (f"join g{i} g using ({parent}))" if parent else f"cross join g{i} g)"),
            f"s{i} as (select *, coalesce(sum(cap) over ({part}order by cap * 1000000 // weight, {name} rows between unbounded preceding and 1 preceding), 0)::hugeint as cap_before, "
            f"sum(weight) over ({part}order by cap * 1000000 // weight, {name} rows between current row and unbounded following)::hugeint as weight_left from o{i})",
            f"f{i} as (select *, cap * weight_left <= (total - cap_before) * weight as is_full from s{i})",
            f"r{i} as (select *, total - coalesce(sum(cap) filter (where is_full) over ({part}), 0)::hugeint as rest, coalesce(sum(weight) filter (where not is_full) over ({part}), 1)::hugeint as weights from f{i})",
            f"g{i + 1} as (select {path}, case when is_full then cap else least(cap, rest * weight // weights) end as total from r{i})",
        ]
    steps += [
        "plan as (select l.*, g.total, case when tokens > 0 then total // tokens else 0 end as epochs from leaves l join g3 g using (domain, lang, source))",
        f"keyed as (select s.*, p.total, p.epochs, p.total - p.epochs * p.tokens as rest, ('0x' || substr(md5('{MIX_SEED}-' || (p.epochs + 1)::varchar || '-' || coalesce(s.doc_id::varchar, '')), 1, 15))::bigint as key "
        "from slim s join plan p using (domain, lang, source))",
        "run as (select *, sum(tokens) over (partition by domain, lang, source order by key, doc_id, tokens rows unbounded preceding) as upto from keyed)",
    ]
    return "with " + ",\n".join(steps) + "\nselect doc_id, domain, lang, source, tokens, (case when total > 0 then epochs + (upto <= rest)::int else 0 end)::bigint as copies from run"


def _pareto_sql() -> str:
    """Layer by layer, what no other of the points that are left dominates."""
    lower = " and ".join(f"b.c{k} <= a.c{k}" for k in range(4))
    steps = [
        "i as (select item_id, floor(100 * min(price) + 0.5)::hugeint as p, min(kind) as kind from items where item_id is not null group by item_id)",
        "s as (select sale_id, min(sold_at::date) as sold from sales where sale_id is not null group by sale_id)",
        "l as (select l.item_id, vendor_id, floor(100 * amount + 0.5)::hugeint as c, floor(100 * discount + 0.5)::hugeint as d, quantity::hugeint as q, date_diff('day', sold, shipped_at::date) as late "
        "from sale_lines l left join s using (sale_id) where l.item_id is not null and vendor_id is not null)",
        "m as (select item_id, vendor_id, sum(c * (100 - d)) filter (where q is not null) as spent, sum(q) filter (where c is not null and d is not null) as n, floor(avg(d))::bigint as discount, "
        "floor(avg(late))::bigint as delay, max(q)::bigint as quantity from l group by item_id, vendor_id)",
        "o as (select item_id, vendor_id, kind as part_type, case when p >= 1 and n <> 0 then floor(spent / (p * n))::bigint end as price, discount, delay, quantity from m left join i using (item_id))",
        "x as (select *, coalesce(kind, '') as k, coalesce(price, 1152921504606846976) as c0, coalesce(-discount, 1152921504606846976) as c1, coalesce(delay, 1152921504606846976) as c2, coalesce(-quantity, 1152921504606846976) as c3 "
        "from (select *, case when part_type is not null then '=' || part_type end as kind from o))",
    ]
    for name, key in (("t", "k, "), ("g", "")):
        same = "b.k = a.k and " if key else ""
        steps.append(f"{name}0 as materialized (select distinct {key}c0, c1, c2, c3 from x)")
        for i in range(1, pareto.LAYERS + 1):
            worse = f"select distinct a.* from {name}{i - 1} a join {name}{i - 1} b on {same}{lower} and (a.c0 <> b.c0 or a.c1 <> b.c1 or a.c2 <> b.c2 or a.c3 <> b.c3)"
            steps.append(f"{name}{i} as materialized ({worse})")
        steps.append(f"{name} as (select {key}c0, c1, c2, c3, count(*) as n from (" + " union all ".join(f"select * from {name}{i}" for i in range(pareto.LAYERS + 1)) + ") group by all)")
    layer = lambda n: f"case when {n}.n <= {pareto.LAYERS} then {n}.n else 0 end"
    return "with " + ",\n".join(steps) + f"\nselect item_id, vendor_id, part_type, price, discount, delay, quantity, {layer('t')} as type_layer, {layer('g')} as global_layer, count(*) over (partition by c0, c1, c2, c3) as n_equal from x join t using (k, c0, c1, c2, c3) join g using (c0, c1, c2, c3)"


_LEDGER_SQL = f"""d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from documents),
w as (select doc_id, i, array_to_string(words[i : i + 7], ' ') as win from (select doc_id, words, unnest(generate_series(1, len(words) - 7)) as i from d where len(words) >= 8)),
t as (select doc_id, i from (select *, count(*) over (partition by doc_id, win) as n from w) where n > 1),
c as (select doc_id, sum(least(8, coalesce(nxt - i, 8)))::bigint as n_repeat_words from (select *, lead(i) over (partition by doc_id order by i) as nxt from t) group by doc_id),
m as (select doc_id, len(words)::bigint as n_words, length(translate(text, {_SPACES}, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
        len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from d left join c using (doc_id)),
b as (select *, {" + ".join(f"case when {rule} then {1 << i} else 0 end" for i, rule in enumerate(rules.RULES.values()))} as failed from m)"""

ORACLE_SQL: dict[str, str] = {
    "op2_chat_preference": _CHAT_SQL,
    "op3_mixing": _mix_sql(),
    "op11_pareto_layers": _pareto_sql(),
    "op4_line_dedup": f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) as i from documents),
k as (select *, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') as key from l),
f as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10),
m as (select k.*, f.key is not null as dropped from k left join f using (key))
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from m group by doc_id
""",
    "op6_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, x.vec_id, list_dot_product(q.v, x.v)::bigint as score from v q join v x on q.vec_id <> x.vec_id where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) where rank <= 5
""",
    "op7_quality_rules": f"""
with {_LEDGER_SQL}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {rules.mask("base")} <> 0 as base_failed,
  failed & {rules.mask("base") | rules.mask("v1")} = 0 as kept, failed::bigint as failed
from b
""",
    "op9_warc": """
with p as (select page_id, url, coalesce(html, '') as html from pages),
h as (select *, sha1(html) as hex, min(page_id) over (partition by html) as first from p),
b as (select *, array_to_string(list_transform(string_split(upper(hex), ''), lambda c: right('000' || bin(instr('0123456789ABCDEF', c) - 1), 4)), '') as bits from h)
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * substr(bits, 5 * i + 1, 1)::int + 8 * substr(bits, 5 * i + 2, 1)::int + 4 * substr(bits, 5 * i + 3, 1)::int + 2 * substr(bits, 5 * i + 4, 1)::int + substr(bits, 5 * i + 5, 1)::int, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to, url, true as sound
from b
""",
}

MORE_SQL: dict[str, str] = {
    "rule_ablations": f"with {_LEDGER_SQL},\nr as (select * from (values " + ", ".join(f"('{p}', '{name}', {1 << i}, {rules.mask(p)})" for p, names in rules.POLICIES.items() for i, name in enumerate(rules.RULES) if name in names) + """) t(policy, rule, bit, mask))
select policy, rule, count(*) filter (where failed & bit <> 0) as n_failed, count(*) filter (where failed & mask = bit) as n_only from b cross join r group by policy, rule
""",
}
