"""Queries of this subpackage: thin wrappers that apply an operator to its whole table and derive the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import bpe_count, collision_ann, crf_lang, divergence, kd_shards, license_scan, mixing, packing, parity_join, perplexity, pii, spelling, toxicity
from pairloom.llm.common import fold_of, read


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.linked(read(spark, sf_dir, "documents"), 3, (9, 10))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = perplexity.judge(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("log_perplexity", 6).alias("log_perplexity"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.listed(pii.KINDS), 256).alias("base_sha256"),
        pii.listed().alias("spans"),
        sum((F.size(k) for k in (*pii.KINDS, "found")), F.lit(0)).cast("long").alias("n_spans"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = crf_lang.identify(docs, crf_lang.learn(docs, fold_of("doc_id", 5) != 0))
    return found.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", F.round("score", 9).alias("score"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, read(spark, sf_dir, "labels"), fold_of("doc_id", 3) != 1)
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "n_hits")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select("doc_id", F.array_join(names, ",").alias("licenses"), F.size("matches").cast("long").alias("n_segments"), F.round(F.array_max(F.transform("matches", lambda m: m["dice"])), 6).alias("best_dice"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "sequence_id", "offset")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = kd_shards.shard(read(spark, sf_dir, "documents"), 8).slots()
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(read(spark, sf_dir, "documents")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_mixing": op3_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii": op5_pii,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_license_scan": op9_license_scan,
    "op10_packing": op10_packing,
    "op11_sharding": op11_sharding,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_source_divergence": op13_source_divergence,
}


def _license_sql() -> str:
    """The licence scan over all segments and all windows, without the cue filter that only spares work."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(name)}, [{', '.join(map(quote, license_scan.word_bigrams(text)))}])" for name, text in license_scan.TEMPLATES)
    t = license_scan.THRESHOLD
    whole = ", ".join(f"({i}, {quote(name)}, [{', '.join(map(quote, grams))}], {size}, {license_scan.least_shared(len(grams), t)})" for i, name, grams, size in license_scan.bodies(license_scan.TEMPLATES))
    return f"""with t(license, grams) as (values {rows}), d as (select doc_id, lower(coalesce(text, '')) as x from documents),
parts as (select doc_id, unnest(string_split(x, chr(10))) as s from d union all select doc_id, unnest(string_split(regexp_replace(regexp_replace(x, '([.!?;])[ \\t]+', '\\1' || chr(31), 'g'), chr(10), chr(31), 'g'), chr(31))) from d
union all select doc_id, unnest(string_split(regexp_replace(x, '\\n[ \\t]*\\n', chr(31), 'g'), chr(31))) from d union all select doc_id, x from d),
paras as (select doc_id, unnest(string_split(regexp_replace(x, '\\n[ \\t]*\\n', chr(31), 'g'), chr(31))) as p from d),
sent as (select doc_id, string_split(regexp_replace(regexp_replace(p, '[ \\t\\r]*\\n[ \\t\\r]*', ' ', 'g'), '([.!?;])[ \\t]+', '\\1' || chr(31), 'g'), chr(31)) as l from paras),
seg as (select distinct doc_id, trim(s, ' ') as s from (select * from parts union all select doc_id, unnest(flatten(list_transform(range(0, {license_scan.WINDOW}), lambda k: list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:i + k], ' '))))) from sent)), w as (select doc_id, s, regexp_extract_all(s, '[\\p{{L}}\\p{{N}}]+') as w from seg),
g as (select doc_id, s, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from w where len(w) > 1),
m as (select doc_id, s, g, license, 2.0::double * len(list_intersect(g, grams)) / (len(g) + len(grams)) as dice from g join t on len(g) * {(2 - t) / t + 1e-9} >= len(grams) and len(grams) * {(2 - t) / t + 1e-9} >= len(g)),
b as (select doc_id, s, any_value(g) as g, max(dice) as dice, arg_min(license, (-dice, license)) as license from m group by doc_id, s having max(dice) >= {t}),
body(t, license, grams, size, least) as (values {whole}), dg as (select doc_id, w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as g from (select doc_id, regexp_extract_all(x, '[\\p{{L}}\\p{{N}}]+') as w from d) where len(w) > 1),
wi as (select doc_id, t, license, grams, w, u.s, list_distinct(g[u.s + 1:u.s + size]) as wg, least(size, len(g)) as l from dg join body on len(list_intersect(list_distinct(g), grams)) >= least, unnest(range(0, greatest(0, len(g) - size) + 1)) as u(s)),
wd as (select doc_id, t, license, grams, s, l, w[s + 1:s + l + 1] as w, 2.0::double * len(list_intersect(wg, grams)) / (len(wg) + len(grams)) as dice from wi),
wb as (select distinct on (doc_id, t) * from wd where dice >= {t} order by doc_id, t, dice desc, s),
wk as (select * from wb a where not exists (select 1 from wb b where b.doc_id = a.doc_id and (b.dice > a.dice or (b.dice = a.dice and (b.l > a.l or (b.l = a.l and b.t < a.t)))) and 2 * (least(a.s + a.l, b.s + b.l) - greatest(a.s, b.s)) > least(a.l, b.l))),
kept as (select doc_id, license, dice from wk union all select doc_id, license, dice from b where not exists (select 1 from wk where wk.doc_id = b.doc_id and len(list_intersect(b.g, wk.grams)) >= {t} * len(b.g)
and contains(' ' || array_to_string(wk.w, ' ') || ' ', ' ' || array_to_string(regexp_extract_all(b.s, '[\\p{{L}}\\p{{N}}]+'), ' ') || ' '))),
r as (select doc_id, string_agg(distinct license, ',' order by license) as licenses, count(*) as n_segments, round(max(dice), 6) as best_dice from kept group by doc_id)
select doc_id, coalesce(licenses, '') as licenses, coalesce(n_segments, 0) as n_segments, best_dice from d left join r using (doc_id)"""


#: Exact Jaccard over 3-word shingles, its classes and its links.
_JACCARD_SQL = """with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from w),
n as (select doc_id, coalesce(len(s), 0) as n from s), u as (select doc_id, unnest(s) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select p.a, p.b from p join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where 100 * p.c >= 90 * (na.n + nb.n - p.c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, root) as (select doc_id, doc_id from documents union select e.b, r.root from r join e on e.a = r.doc_id)
select n.doc_id, n.n as n_shingles, (select min(root) from r where r.doc_id = n.doc_id) as component_id, (select count(*) from e where e.a = n.doc_id) as n_links from n"""

#: crc32 of a text, by its table; for ``with``.
_CRC_SQL = """crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as tab)"""


def _crc(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)"
    return f"xor(list_reduce({octets}, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255)::int + 1]), 4294967295), 4294967295)"


def _kd_sql(levels: int = 3) -> str:
    """The tree level by level: each node's widest dimension, running sums in key order, and the key in which the target falls."""
    bits = lambda x: f"('0x' || substr(md5({x}), 1, 5))::bigint"
    of = lambda d: f"coalesce({bits(d)}, 0)"
    md5 = "('0x' || substr(md5(tie::varchar), 1, 8))::bigint"
    steps = [f"""ends as (select min(n_chars)::double as lo, max(n_chars)::double as hi from documents),
l0 as (select doc_id, strlen(coalesce(text, '')) + 1 as size, {_crc("coalesce(text, '')")} as text_crc32, {of('lang')} as a1, {of('source')} as a2,
coalesce(case when lo < hi then floor((n_chars::double - lo) / (hi - lo) * 1048575)::bigint end, 0) as a3, ({bits("coalesce(text, '')")} << 20) | {bits("coalesce(doc_id::varchar, '')")} as tie, 0 as node, {1 << levels} as k from documents, ends, crc)"""]
    for i in range(levels):
        steps.append(f"""n{i} as (select node, k, sum(size) as w, max(a1) - min(a1) as e1, max(a2) - min(a2) as e2, max(a3) - min(a3) as e3 from l{i} group by all),
d{i} as (select node, case when e1 >= e2 and e1 >= e3 then 1 when e2 >= e3 then 2 else 3 end as dim, (w // k) * (k // 2) + ((w % k) * (k // 2)) // k as target from n{i}),
k{i} as (select l.*, target, ((case dim when 1 then a1 when 2 then a2 else a3 end) << 40) | tie as key from l{i} l join d{i} using (node)),
s{i} as (select node, key, target, sum(own) over (partition by node order by key) as through, own from (select node, key, target, sum(size) as own from k{i} group by all)),
c{i} as (select node, min(key) as key, arg_min(through, key) as through, arg_min(own, key) as own, any_value(target) as target from s{i} where through >= target group by node),
l{i + 1} as (select doc_id, size, text_crc32, a1, a2, a3, tie, node + case when k{i}.key < c.key + (2 * (c.target - (through - own)) >= own)::int then 0 else k // 2 end as node, k // 2 as k from k{i} join c{i} c using (node))""")
    return f"with {_CRC_SQL}, {', '.join(steps)} select doc_id, size::bigint as size, text_crc32, 'bytes' as law, node::int as shard, row_number() over (partition by node order by {md5}, doc_id, text_crc32, size) - 1 as slot, null::int as grown_shard from l{levels}"


_VARIANTS_SQL = f"""with recursive {_CRC_SQL}, r as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as w from documents),
c as (select doc_id, w, count(*) as n from r group by all), h as (select w, n, {_crc("coalesce(doc_id::varchar, '') || ':' || w")} as h from c, crc),
m as (select case when h % 97 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as w, n from h),
v as (select w, sum(n)::bigint as n from m where length(w) >= 5 group by w having sum(n) >= 3),
g as (select w, i, substr(w, 1, i::int - 1) || substr(w, i::int + 1) as s from (select w, unnest(range(1, length(w) + 1)) as i from v)),
p as (select a.w, b.w as x from g a join g b on a.i = b.i and a.s = b.s and a.w <> b.w union select w, s from g where s in (select w from v) union select s, w from g where s in (select w from v)),
b as (select p.w, count(*) as n_near, arg_min(x, (-v.n, x)) as x, max(v.n) as xn from p join v on v.w = p.x group by p.w),
f as (select v.w, v.n, coalesce(n_near, 0) as n_near, case when xn >= 2 * v.n then x end as form, case when xn >= 2 * v.n then xn end as form_n from v left join b using (w)),
t(w, z) as (select w, w from f union all select t.w, f.form from t join f on f.w = t.z where f.form is not null)
select f.w as word, f.form, z as root, f.n, f.n_near, f.form_n from f join t on t.w = f.w join f e on e.w = z and e.form is null"""

_DIVERGENCE_SQL = """with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w, row_number() over () as i from documents),
x as (select lang, source, i, unnest(w) as term from d), t as (select lang, term from x group by all having count(distinct i) >= 10),
c as (select lang, source, term, count(*)::hugeint as n from x semi join t using (lang, term) group by all), g as (select distinct lang, source from d), v as (select lang, count(*)::hugeint as v from t group by lang),
s as (select g.lang, g.source, coalesce(any_value(v.v), 0) + 0::hugeint as v, coalesce(sum(c.n), 0)::hugeint as n from g left join v using (lang) left join c on c.lang = g.lang and c.source = g.source group by all),
k as (select s.lang, s.source, t.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (s.n + 2 * s.v) as p from s join t using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = t.term),
l as (select lang, term, sum(n)::hugeint as n from c group by all), q as (select lang, term, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang)::hugeint + 2 * (count(*) over (partition by lang))) as q from l),
pv as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::hugeint as f from k a join k b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pr as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
tr as (select k.lang, k.source, 'term' as part, k.term as item, ((p - q) * (p - q) // (p + q))::bigint as value from k join q using (lang, term) where k.n > 0 and p > q),
o as (select *, row_number() over (partition by lang, source, part order by value desc, item) as r from (select * from pr union all select * from tr)) select lang, source, part, item, value, r::int as rank from o where part = 'pair' or r <= 10"""

ORACLE_SQL: dict[str, str] = {"op11_sharding": _kd_sql(), "op12_spelling_variants": _VARIANTS_SQL, "op13_source_divergence": _DIVERGENCE_SQL, "op1_ngram_jaccard_join": _JACCARD_SQL, "op9_license_scan": _license_sql()}
