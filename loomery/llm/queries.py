"""Registered queries opN_<name> of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fim, licenses, mixing, neardup, packing, quality, secrets, toolcalls, topk, trie, urlrules, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner is the source; a repository is a source's part in one language. ownership: owners:repositories:verdict of each span."""
    docs = table(spark, sf_dir, "documents").withColumn("repo", F.concat_ws("/", "source", "lang"))
    names = F.array(*map(F.lit, secrets.KINDS))
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.PATTERNS))
    number = lambda field, x: F.size(F.filter("spans", lambda s: s[field] == F.lit(x))).cast("long")
    kinds = [number("kind", k).alias(f"n_{p[0]}") for k, p in enumerate(secrets.PATTERNS)]
    verdicts = [number("verdict", v).alias(f"n_{v}") for v in ("live", "copied")]
    owned = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["owners"], s["repos"], s["verdict"])))
    return secrets.scan(docs).select("doc_id", *kinds, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), *verdicts, owned.alias("ownership"))


def op2_hyperminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


#: Fixed rules: host, path, action.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3_fpgrowth_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of low quality block; labels and pages share their ids."""
    labels = table(spark, sf_dir, "labels").where("quality is not null").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "block").otherwise("allow").alias("verdict"))
    return urlrules.judge(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link(table(spark, sf_dir, "conversations"))


def op5_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).drop("url")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op8_pivot_distance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_isolation_forest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op10_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    written = F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["first_word"], m["end_word"], F.round(m["containment"], 4)))
    return found.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"), F.array_join(written, ",").alias("matches"))


def op11_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restored(fim.arranged(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *(F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 finds by its fixed patterns alone."""
    return op1_ownership_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def url_curated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 decides by curated rules: host, path, rule, and the rule's verdict."""
    return op3_fpgrowth_urls(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 counts and its base rules say."""
    return op9_isolation_forest_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: f for name, f in sorted(globals().items()) if name.startswith("op") and name[2].isdigit()}
    return own | {f.__name__: f for f in (secret_base_spans, url_curated_rules, quality_base_counts)}


WORD = r"[^\x20\x09-\x0D]+"
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: Number and name of a kind, its pattern, and the group whose length is checked.
SPANS = " union all ".join(f"select doc_id, {k} k, '{name}' kind, regexp_extract_all(x, '{p}') m, string_split_regex(x, '{p}') s, regexp_extract_all(x, '{p}', {g}) v, {n} least from t" for k, (name, p, g, n) in enumerate((("assign", ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]{16,}", 0, 16))))
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "secret_base_spans": rf"""
with t as (select doc_id, coalesce(text, '') x from documents), p as ({SPANS}), i as (select *, unnest(range(1, len(m) + 1)) i from p),
f as (select doc_id, k, kind, length(m[i]) n, cast(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint) a from i where length(v[i]) >= least),
g as (select doc_id, count(*) filter (where k = 0) n_assign, count(*) filter (where k = 1) n_access, count(*) filter (where k = 2) n_hex, string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, k) l from f group by 1)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(l, '')) base_sha256 from documents left join g using (doc_id)""",
    "url_curated_rules": """
with r(h, p, a) as (values """ + ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES) + """),
u as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) path from pages),
f as (select page_id, arg_max(h || p, length(h || p)) rule, arg_max(a, length(h || p)) ruled from u join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by 1)
select page_id, host, path, rule, ruled from u left join f using (page_id)""",
    "op4_tool_call_linking": r"""
with m as (select conv_id, turn, role, coalesce(text, '') t, case role when 'user' then 'call' when 'assistant' then 'result' else 'message' end kind, case role when 'user' then conv_id || ':' || turn when 'assistant' then conv_id || ':' || (turn - 1) end id from conversations),
e as (select m.*, p.turn other, row_number() over (partition by m.conv_id order by m.turn) - 1 position from m left join m p on p.conv_id = m.conv_id and p.id = m.id and p.kind <> m.kind)
select conv_id, turn, position, kind, id, case kind when 'message' then 'plain' when 'call' then case when other is null then 'unanswered' else 'answered' end else case when other is null then 'orphan' else 'linked' end end status, other partner_turn,
not (kind = 'call' and t = '') as valid, case when kind = 'call' and t = '' then 'prompt: too short' else '' end errors,
case kind when 'call' then '{"arguments":{"prompt":' || to_json(t) || ',"turn":' || turn || '},"id":"' || id || '","name":"reply","type":"call"}' when 'result' then '{"content":' || to_json(t) || ',"id":"' || id || '","type":"result"}' else '{"content":' || to_json(t) || ',"type":"message"}' end json from e""",
    "quality_base_counts": rf"""
with t as (select doc_id, coalesce(text, '') x, regexp_extract_all(coalesce(text, ''), '{WORD}') w from documents),
l as (select doc_id, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '{WORD}')) l from t),
g as (select doc_id, unnest(range(1, len(w) - 1)) i, w from t where len(w) > 2), h as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] tri from g),
r as (select doc_id, i, count(*) over (partition by doc_id, tri) c from h), c as (select doc_id, count(distinct j) n from (select doc_id, unnest([i, i + 1, i + 2]) j from r where c > 1) group by 1)
select t.doc_id, len(w) n_words, cast(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) as bigint) word_chars, len(regexp_extract_all(x, '[#*$%&|<>]')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines, coalesce(n, 0) n_repeat_words, len(w) < 50 or 100 * coalesce(n, 0) > 50 * len(w) base_failed from t join l using (doc_id) left join c using (doc_id)""",
    "op2_hyperminhash_neardup": rf"""
with recursive words as (select doc_id, list_filter(string_split_regex({LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '') w from documents),
sets as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) s from words),
sizes as (select doc_id, count(*) n from sets group by 1),
common as (select a.doc_id a, b.doc_id b, count(*) i from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
reach as (select doc_id, doc_id r from documents union select reach.doc_id, b from reach join links on a = r),
low as (select doc_id, min(r) component_id from reach group by 1)
select d.doc_id, coalesce(n, 0) n_shingles, component_id, d.doc_id = component_id kept from documents d left join sizes using (doc_id) join low using (doc_id)""",
    "op11_positional_decontamination": rf"""
with d as (select row_number() over () k, doc_id, regexp_extract_all({LOWER}, '{ITEM_WORD}') w from documents), b as (select item_id, regexp_extract_all({LOWER}, '{ITEM_WORD}') w from benchmark),
s as (select item_id, unnest(case when len(w) = 0 then [] when len(w) < 10 then [w] else list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) end) x from b),
l as (select distinct len(x) n from s), p as (select k, n, unnest(range(1, len(w) - n + 2)) i, w from d, l where len(w) >= n),
o as (select distinct k, i, n, item_id from (select k, i, n, w[i:i + n - 1] x from p) join s using (x)),
h as (select k, count(*) n_hit from (select distinct k, unnest(range(i, i + n)) j from o) group by 1),
t as (select k, count(*) n_items, string_agg(i, ',' order by i) ids from (select distinct k, cast(item_id as varchar) i from o) group by 1)
select doc_id, coalesce(len(w), 0) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from d left join h using (k) left join t using (k)""",
    "op12_conversation_trie": rf"""
with i as (select conv_id, unnest(range(1, len(cast(conv_id as varchar)) + 1)) i, cast(conv_id as varchar) s from (select distinct conv_id from conversations where conv_id is not null)),
b as (select conv_id, list(ascii(s[i]) order by i) b from i group by 1),
h as (select conv_id, xor(list_reduce(b, lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda y, z: xor(y >> 1, (y & 1) * 3988292384)), 4294967295), 4294967295) % 4 h from b),
t as (select conv_id, coalesce(role, '') role, coalesce(text, '') text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) n from conversations where conv_id is not null),
r as (select c.conv_id, 0 own, n, role, text from h c join t on t.conv_id = c.conv_id - c.conv_id % 20 and n <= h union all select t.conv_id, 1, n, role, text from t join h using (conv_id) where n > h),
o as (select conv_id, row_number() over (partition by conv_id order by own, n) depth, struct_pack(r := role, t := text) turn from r),
p as (select conv_id, depth, list(turn) over (partition by conv_id order by depth) path, len(regexp_extract_all(turn.t, '{WORD}')) words from o union all select conv_id, 0, [], 0 from h),
l as (select conv_id, max(depth) length from p group by 1),
n as (select depth, path, min(conv_id) id, count(*) n_convs, any_value(words) words, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where depth = length), '')) ends, bool_and(depth = length) leaf from p join l using (conv_id) group by 1, 2),
a as (select u.depth d0, u.path p0, n.depth, n.path, n.id, n.n_convs, n.words, n.leaf from n join p u on u.conv_id = n.id and u.depth <= n.depth)
select n.id conv_id, n.depth, q.id parent_conv_id, n.n_convs, count(*) filter (where a.depth = n.depth + 1) n_children, count(*) filter (where a.leaf) n_leaves, cast(sum((a.n_convs - 1) * a.words) as bigint) saved_tokens, n.ends ends_sha256
from n join a on a.d0 = n.depth and a.p0 = n.path left join n q on q.depth = n.depth - 1 and q.path = n.path[1:n.depth - 1] group by all""",
    "op13_fill_in_middle": r"""
with d as (select doc_id, coalesce(text, '') x, sha256('1:' || coalesce(cast(doc_id as varchar), '')) s from documents),
u as (select *, regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]') u, cast('0x' || s[1:8] as bigint) h1, cast('0x' || s[9:16] as bigint) h2, cast('0x' || s[17:24] as bigint) h3, cast('0x' || s[25:32] as bigint) h4 from d),
c as (select *, len(u) n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) i, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) j,
case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from u),
p as (select *, array_to_string(u[1:i], '') a, array_to_string(u[i + 1:j], '') b, array_to_string(u[j + 1:n], '') c from c)
select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then length(a) end prefix_chars, case when form <> 'plain' then length(b) end middle_chars,
sha256(case form when 'plain' then x when 'psm' then '<P>' || a || '<S>' || c || '<M>' || b else '<S>' || c || '<P>' || a || '<M>' || b end) output_sha256, sha256(x) restored_sha256 from p""",
    "op6_chunked_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha1(coalesce(html, '')) payload_digest from pages),
m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) top from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < top then 'revisit' else 'response' end record_type, case when payload_bytes >= 1000 and page_id < top then top end refers_to from m""",
    "op7_source_mix": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size, cast('0x' || substr(md5('42:' || doc_id), 1, 15) as bigint) k from documents),
s as (select source, cast(sum(size) as bigint) source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 w from d group by 1),
r as (select *, 3 * source_size / w fill, sum(source_size) over () total, coalesce(sum(3 * source_size) over (order by 3 * source_size / w, source rows between unbounded preceding and 1 preceding), 0) before, sum(w) over (order by 3 * source_size / w, source rows between current row and unbounded following) rest from s),
u as (select *, (total - before) / rest unit from r),
c as (select *, bool_and(unit > fill) over (order by fill, source rows unbounded preceding) capped from u),
t as (select source, source_size, cast(case when capped then 3 * source_size else w * first_value(unit) over (order by capped, fill, source) end as double) target from c),
q as (select *, least(3, cast(floor(target / source_size) as bigint)) whole from t),
b as (select d.*, source_size, target, whole, cast(round(target - whole * source_size) as bigint) left_over, coalesce(sum(size) over (partition by source order by k, doc_id rows between unbounded preceding and 1 preceding), 0) pos from d join q using (source))
select doc_id, cast(size as bigint) size, source_size, target, cast(whole * size + greatest(0, least(size, left_over - pos)) as bigint) taken from b""",
    "op8_pivot_distance_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v from embeddings),
s as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
k as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) rank from s)
select query_id, rank, vec_id, score from k where rank <= 10""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
