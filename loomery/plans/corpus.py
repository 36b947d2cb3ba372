"""Corpus reports, text kernel, exact duplicates, splits and samples over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as X
from ..operators import dedup as D
from ..operators import quality as Q
from ..operators.tables import keep_table, small, spread
from .registry import lit, query

N1 = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"


@query(f"""
with x as (select source, lang, {N1.format('text')} c from documents),
per as (select md5(c) h, source, count(*) n from x group by 1, 2),
spread as (select h, count(*) keys from per group by 1),
shared as (select source, count(*) distinct_contents, cast(sum(case when n > 1 then 1 else 0 end) as bigint) repeated_contents, cast(sum(case when keys > 1 then 1 else 0 end) as bigint) shared_contents from per join spread using (h) group by 1)
select * from (select source, count(*) n, count(distinct lang) languages, cast(sum(case when c = '' then 1 else 0 end) as bigint) empty, min(length(c)) shortest, max(length(c)) longest, round(avg(length(c)), 2) mean_length, median(length(c)) median_length from x group by 1) join shared using (source)
""")
def corpus_coverage(t):
    return Q.coverage(t.documents, "source", X.norm_basic("text"), "lang")


@query("select d.source, l.quality, count(*) n from documents d join labels l using (doc_id) group by 1, 2")
def source_native_labels(t):
    return Q.distribution(t.documents.join(t.labels, "doc_id"), "source", "quality")


@query(f"select md5({N1.format('text')}) hash, count(*) n, count(distinct source) sources from documents group by 1 having count(*) > 1")
def duplicate_groups(t):
    return Q.duplicate_groups(t.documents, X.norm_basic("text"), "source")


@query(f"select doc_id, md5({N1.format('text')}) n1, md5(array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''), ' ')) n7, sha256(text) sha from documents")
def norm_forms(t):
    return t.documents.select("doc_id", F.md5(X.norm_basic("text")).alias("n1"), F.md5(X.norm_split("text")).alias("n7"), F.sha2("text", 256).alias("sha"))


@query("""select doc_id, md5(trim(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'))) n3, md5(trim(regexp_replace(lower(regexp_extract(text, '^[^\\n]*')), '\\s+', ' ', 'g')) || chr(10) || trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) n5 from documents""")
def norm_subject_forms(t):
    """N3 with an empty subject, N5 with the first line as the subject."""
    return t.documents.select("doc_id", F.md5(X.norm_content(F.lit(""), "text")).alias("n3"), F.md5(X.norm_fields(F.regexp_extract("text", r"^[^\n]*", 0), "text")).alias("n5"))


@query("""
with p as (select a.conv_id, a.turn, lower(a.text) x, lower(b.text) y from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
w as (select *, list_distinct(list_filter(string_split_regex(x, '\\s+'), lambda v: v <> '')) wx, list_distinct(list_filter(string_split_regex(y, '\\s+'), lambda v: v <> '')) wy,
  list_distinct(list_transform(range(1, greatest(1, length(x) - 2)), lambda i: substr(x, i, 4))) gx, list_distinct(list_transform(range(1, greatest(1, length(y) - 2)), lambda i: substr(y, i, 4))) gy from p)
select conv_id, turn, round(len(list_intersect(wx, wy)) / (len(wx) + len(wy) - len(list_intersect(wx, wy))), 9) word_sim,
  round(case when x = y then 1.0 when length(x) < 4 or length(y) < 4 then 0.0 else len(list_intersect(gx, gy)) / (len(gx) + len(gy) - len(list_intersect(gx, gy))) end, 9) char_sim,
  round(least(length(x), length(y)) / greatest(length(x), length(y)), 9) length_ratio from w
""")
def pair_similarity(t):
    """Every turn against the next one of its conversation."""
    c = t.conversations.select("conv_id", "turn", F.lower("text").alias("x"))
    p, x, y = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"]), F.col("x"), F.col("y")
    return p.select("conv_id", "turn", F.round(sim.jaccard(sim.word_set(x), sim.word_set(y)), 9).alias("word_sim"), F.round(sim.char_jaccard(x, y), 9).alias("char_sim"), F.round(sim.length_ratio(x, y), 9).alias("length_ratio"))


@query(f"select doc_id, source from (select *, row_number() over (partition by md5({N1.format('text')}) order by doc_id) r from documents) where r = 1")
def exact_dedup_first(t):
    return D.first_of(t.documents.select("doc_id", "source", "text"), F.md5(X.norm_basic("text")), "doc_id").select("doc_id", "source")


@query(f"select md5({N1.format('d.text')}) key, count(*) n, count(distinct l.quality) labels, count(distinct l.quality) > 1 conflicting from documents d join labels l using (doc_id) group by 1 having count(*) > 1")
def integrity_conflicts(t):
    return Q.conflicts(t.documents.join(t.labels, "doc_id"), F.md5(X.norm_basic("text")), "quality")


@query("select d.doc_id, b.item_id from documents d, benchmark b where length(d.text) >= 30 and length(b.text) >= 30 and contains(d.text, b.text)")
def benchmark_contamination(t):
    return D.contained(t.documents, "doc_id", X.text("text"), t.benchmark, "item_id", X.text("text"))


def texts(t):
    """(doc_id, rep) of all documents, the smallest doc_id of equal normalised texts, and (doc_id, c), the texts of the first
    ones: the latter over a written table, where texts stay in place."""
    rows = keep_table(spread(t.documents.select("doc_id", "text")).select("doc_id", X.norm_basic("text").alias("c")))
    of = keep_table(D.first_texts(rows, "doc_id", F.col("c")).withColumnRenamed("id", "doc_id"))
    copies = small(keep_table(of.where("doc_id <> rep").select("doc_id")))
    return of, rows.join(copies, "doc_id", "left_anti")


def near(t, **bounds):
    """(doc_id, rep) and the pairs alike between first texts, as written tables."""
    of, firsts = texts(t)
    found = D.Texts(firsts, "doc_id", F.col("c"), keep_table, **bounds)
    words, chars = bounds.get("words", 0.80), bounds.get("chars", 0.85)
    return of, keep_table(found.pairs().where((F.col("word_sim") >= words) | (F.col("char_sim") >= chars)))


def meeting_sql(v: str, items: str, threshold: float) -> tuple[str, str]:
    """SQL of pairs whose rarest items (enough of them for the similarity) meet, from rows (id, <items>) of v."""
    return f"""select a.id a, b.id b from {items}p a join {items}p b on a.y = b.y and a.id < b.id""", f"""{items}u as (select id, unnest({items}) y from {v}), {items}d as (select y, count(*) df from {items}u group by 1), {items}r as (select id, y, row_number() over (partition by id order by df, y) r from {items}u join {items}d using (y)),
{items}p as (select r.id, y from {items}r r join {v} using (id) where r <= len({items}) - ceil({threshold} * len({items}) - 1e-9) + 1)"""


def near_sql(least: int, ratio: float) -> str:
    """SQL of the pairs alike(a, b, ws, cs) between first texts; x has all of them."""
    (by_w, w), (by_g, g) = meeting_sql("v", "w", 0.8), meeting_sql("v", "g", 0.85)
    return f"""x as (select doc_id, {N1.format('text')} c from documents), k as (select c, min(doc_id) id from x group by 1),
z as (select id, c, length(c) n, list_distinct(list_filter(string_split(c, ' '), lambda v: v <> '')) w, string_split(c, '') ch from k where length(c) >= {least}),
v as materialized (select id, n, w, list_distinct(list_transform(range(1, n - 2), lambda i: hash(ch[i] || ch[i + 1] || ch[i + 2] || ch[i + 3]))) g from z), {w}, {g},
p as (select m.a, m.b, a.w wa, b.w wb, a.g ga, b.g gb from ({by_w} union {by_g}) m join v a on a.id = m.a join v b on b.id = m.b where least(a.n, b.n) >= {ratio} * greatest(a.n, b.n)),
i as (select a, b, len(list_intersect(wa, wb)) iw, len(wa) + len(wb) nw, len(list_intersect(ga, gb)) ig, len(ga) + len(gb) ng from p),
alike as (select a, b, iw / (nw - iw) ws, ig / (ng - ig) cs from i)"""


REACH = """links as (select a, b from {0} union all select b, a from {0} union all select k.id, x.doc_id from x join k using (c) where k.id <> x.doc_id union all select x.doc_id, k.id from x join k using (c) where k.id <> x.doc_id),
reach as (select doc_id, doc_id r from x union select reach.doc_id, b from reach join links on a = r)
select doc_id, min(r) component_id from reach group by 1"""


@query(f"with {near_sql(15, 0.7)} select a, b, round(ws, 9) word_sim, round(cs, 9) char_sim from alike where ws >= 0.8 or cs >= 0.85 union all select k.id, x.doc_id, 1.0, 1.0 from x join k using (c) where k.id <> x.doc_id")
def near_dup_pairs(t):
    """Texts alike by words (0.8) or character 4-grams (0.85), between first ones of equal texts; copies with theirs."""
    rows, pairs = near(t)
    one = F.lit(1.0)
    copies = rows.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), one.alias("word_sim"), one.alias("char_sim"))
    return pairs.select("a", "b", F.round("word_sim", 9).alias("word_sim"), F.round("char_sim", 9).alias("char_sim")).unionByName(copies)


def grouped(rows, pairs):
    """doc_id, component_id of all documents: the smallest doc_id reachable over pairs and copies."""
    links = pairs.select("a", "b").union(rows.where("doc_id <> rep").select("rep", "doc_id"))
    found = D.components(keep_table(links), keep_table)
    return rows.join(found, rows.doc_id == found.node, "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def joined(t, accept):
    """Groups over the links that accept takes of compared pairs of first texts: no family of copies makes all its pairs.

    accept(first texts) is called before any pair is found, and gives pairs, texts of some -> pairs."""
    of, firsts = texts(t)
    take = accept(firsts)
    found = D.Texts(firsts, "doc_id", F.col("c"), keep_table)
    return grouped(of, found.links(lambda pairs: take(pairs, found.texts)))


@query(f"with recursive {near_sql(15, 0.7)}, good as (select a, b from alike where ws >= 0.8 or cs >= 0.85), {REACH.format('good')}")
def near_dup_components(t):
    """Groups of equal and near texts, by words or by characters."""
    return joined(t, lambda firsts: lambda pairs, texts: pairs.where("word_sim >= 0.8 or char_sim >= 0.85"))


@query(f"""with recursive {near_sql(15, 0.7)}, u as (select id, unnest(w) t from v), often as (select t from u where length(t) >= 3 group by 1 having count(*) between 2 and (select greatest(20, floor(0.2 * count(*))) from k)),
mine as (select id, list(t) l from u join often using (t) group by 1),
good as (select a, b from alike join mine m on m.id = a join mine o on o.id = b where list_has_any(m.l, o.l) and (ws >= 0.8 or (ws >= 0.4 and cs >= 0.85))), {REACH.format('good')}""")
def near_dup_mail_components(t):
    """Groups as in mail corpora: pairs share an informative word, and characters count from a word similarity of 0.4."""
    def accept(firsts):
        good = keep_table(D.informative(firsts, F.col("c")))
        some = lambda pairs: keep_table(pairs.where("word_sim >= 0.8 or (word_sim >= 0.4 and char_sim >= 0.85)"))
        return lambda pairs, texts: D.sharing(some(pairs), texts, "id", F.col("c"), good)

    return joined(t, accept)


BOILER = "text"
for _p in X.FORWARDED:
    BOILER = f"regexp_replace({BOILER}, {lit('(?is)' + _p)}, '', 'g')"
BOILER = f"array_to_string(list_filter(string_split({BOILER}, chr(10)), lambda x: not starts_with(trim(x), '>')), chr(10))"
for _p in (*X.DISCLAIMERS, X.SIGN_OFF):
    BOILER = f"regexp_replace({BOILER}, {lit('(?is)' + _p)}, '', 'g')"


GREEDY = meeting_sql("v", "g", 0.85)


@query(f"""with recursive y as (select doc_id, {N1.format(BOILER)} c from documents), k as (select c, min(doc_id) id from y group by 1), z as (select id, c, length(c) n, string_split(c, '') ch from k where length(c) >= 20),
v as materialized (select id, c, n, list_distinct(list_transform(range(1, n - 2), lambda i: hash(ch[i] || ch[i + 1] || ch[i + 2] || ch[i + 3]))) g from z), {GREEDY[1]},
i as (select m.a, m.b, len(list_intersect(a.g, b.g)) ig, len(a.g) + len(b.g) ng from ({GREEDY[0]} group by 1, 2) m join v a on a.id = m.a join v b on b.id = m.b where abs(b.n - a.n) < b.n * 0.4),
e as (select a, b from i where ig / (ng - ig) >= 0.85 union select least(a.id, b.id), greatest(a.id, b.id) from v a join v b on a.id <> b.id and a.n >= b.n and b.n >= 30 and contains(a.c, b.c)),
o as materialized (select id, row_number() over (order by id) pos, coalesce(l, []) l from k left join (select b, list(a) l from e group by 1) on b = id),
g as (select cast(0 as bigint) pos, cast([] as bigint[]) kept union all select o.pos, case when list_has_any(l, kept) then kept else list_append(kept, id) end from g join o on o.pos = g.pos + 1)
select unnest(kept) doc_id from (select kept from g order by pos desc limit 1)""")
def greedy_dedup(t):
    """Documents kept by the pass that drops what equals an earlier one without boilerplate, contains or is contained in
    an earlier kept one, or is alike by characters."""
    rows = t.documents.select("doc_id", X.strip_boilerplate("text").alias("c"))
    first = D.first_texts(rows, "doc_id", F.col("c")).where("id = rep").select("id")
    rows = keep_table(rows.join(first.withColumnRenamed("id", "doc_id"), "doc_id"))
    edges = D.greedy_edges(rows, "doc_id", F.col("c"), keep_table)
    return D.survivors(rows.select(F.col("doc_id").alias("id")), edges, keep_table).withColumnRenamed("id", "doc_id")


SPLIT = "case when substr(md5('42:' || doc_id), 1, 1) < 'a' then 'train' when substr(md5('42:' || doc_id), 1, 1) < 'd' then 'val' else 'test' end"


@query(f"select md5({N1.format('text')}) hash, count(*) n, array_to_string(list_sort(list(distinct split)), ',') splits from (select *, {SPLIT} split from documents) group by 1 having count(distinct split) > 1")
def split_leakage_text(t):
    first = F.substring(D.seeded(42, "doc_id"), 1, 1)
    split = F.when(first < "a", "train").when(first < "d", "val").otherwise("test")
    return D.leaks(t.documents.withColumn("split", split), X.norm_basic("text"), "split")


@query("select doc_id, case when r < floor(n * 0.6) then 'train' when r < floor(n * 0.6) + floor(n * 0.2) then 'val' else 'test' end split from (select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) - 1 r, count(*) over () n from documents)")
def exact_ratio_split(t):
    return D.ratio_split(t.documents.select("doc_id"), "doc_id", {"train": 0.6, "val": 0.2, "test": 0.2}).select("doc_id", "split")


@query("select doc_id, quality, case when row_number() over (partition by quality order by md5('42:' || doc_id), doc_id) <= floor(count(*) over (partition by quality) * 0.2) then 'test' else 'train' end split from labels where quality is not null")
def stratified_holdout(t):
    """A fifth of each class is held out."""
    return D.ratio_split(t.labels.where("quality is not null").select("doc_id", "quality"), "doc_id", {"test": 0.2, "train": 0.8}, strata=["quality"]).select("doc_id", "quality", "split")


@query(f"select doc_id removed, kept from (select doc_id, min(doc_id) over (partition by md5({N1.format('text')})) kept from documents) where doc_id <> kept")
def exact_dedup_removed(t):
    """What exact dedup removes, and in favour of which row."""
    return D.removed(t.documents, F.md5(X.norm_basic("text")), "doc_id")


@query("select doc_id, source, quality, turn from (select d.doc_id, d.source, l.quality, row_number() over (partition by d.source, l.quality order by md5('42:' || d.doc_id), d.doc_id) turn from documents d join labels l using (doc_id)) order by turn, source, quality limit 100")
def round_robin_sample(t):
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "source", "quality")
    return D.round_robin(rows, ["source", "quality"], "doc_id", 100).select("doc_id", "source", "quality", F.col("turn").cast("long").alias("turn"))


@query("select doc_id, source, rank from (select doc_id, source, row_number() over (partition by source order by doc_id) rank from documents where source in ('src1', 'src2', 'src3')) where rank <= case source when 'src1' then 34 else 33 end")
def source_quota(t):
    return D.quota(t.documents, "source", "doc_id", ["src1", "src2", "src3"], 100).select("doc_id", "source", F.col("rank").cast("long").alias("rank"))


@query("select doc_id, source, cast(doc_id // 250 + 1 as bigint) batch, doc_id % 250 + 2 excel_row from documents")
def batch_manifest(t):
    return D.batches(t.documents, "doc_id", 250).select("doc_id", "source", "batch", "excel_row")


@query("select source, count(*) n from documents group by 1")
def source_manifest(t):
    return Q.distribution(t.documents, "source")


@query(f"select doc_id, md5(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{FFFE}}\\x{{FFFF}}]', '', 'g')) clean, md5(case when length(text) > {X.CELL_LIMIT} then substr(text, 1, {X.CELL_LIMIT - len(X.CELL_MARKER)}) || '{X.CELL_MARKER}' else text end) cell, length(text) > {X.CELL_LIMIT} truncated from documents where text is not null")
def xml_cells(t):
    """Cells of a sheet: XML 1.0 characters only, cut at the sheet's limit with a marker."""
    rows = t.documents.where("text is not null")
    return rows.select("doc_id", F.md5(X.sanitize_xml("text")).alias("clean"), F.md5(X.truncate_cell(X.text("text"))).alias("cell"), (F.length("text") > X.CELL_LIMIT).alias("truncated"))


@query("""select page_id, md5(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<.*?>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&hellip;', '...')) plain,
md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), 'https?://\\S+', '[Link]', 'g'), '\\s+', ' ', 'g'))) simple from pages""")
def html_strip(t):
    return t.pages.select("page_id", F.md5(X.strip_html("html")).alias("plain"), F.md5(X.simplify("html")).alias("simple"))


@query("""select conv_id, turn, case when length(c) <= 60 then c else (case when regexp_replace(substr(c, 1, 57), ' [^ ]*$', '') <> '' then regexp_replace(substr(c, 1, 57), ' [^ ]*$', '') else substr(c, 1, 57) end) || '...' end summary
from (select conv_id, turn, regexp_replace(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '\\s+', ' ', 'g') c from conversations)""")
def summary_trim(t):
    return t.conversations.select("conv_id", "turn", X.summary("text", 60).alias("summary"))


BODY = r"regexp_replace(regexp_replace(regexp_replace(text, '\n\s*\n', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), '\t+', ' ', 'g')"
for _p in X.CLEANED:
    BODY = f"regexp_replace({BODY}, {lit('(?sm)' + _p)}, '', 'g')"


@query(f"select doc_id, md5(trim(case when length(c) > 3000 then substr(c, 1, 3000) || '... [truncated for processing]' else c end, ' ' || chr(10) || chr(9) || chr(13))) body from (select doc_id, {BODY} c from documents where text is not null)")
def body_clean(t):
    return t.documents.where("text is not null").select("doc_id", F.md5(X.clean_body("text")).alias("body"))


@query("""select doc_id, s subject, md5(case when s <> '' then trim('Subject: ' || s || chr(10) || 'Body: ' || b, ' ' || chr(10)) else b end) full_text from (select doc_id, trim(regexp_extract(text, '^[^\\n]*'), ' ' || chr(10) || chr(9) || chr(13)) s, trim(text, ' ' || chr(10) || chr(9) || chr(13)) b from documents)""")
def full_texts(t):
    first = F.regexp_extract("text", r"^[^\n]*", 0)
    return t.documents.select("doc_id", X.strip(first).alias("subject"), F.md5(X.full_text(first, "text")).alias("full_text"))


@query("select doc_id, unnest(regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b')) email from documents")
def document_emails(t):
    return t.documents.select("doc_id", F.explode(X.all_of("text", X.EMAIL)).alias("email"))


# Words that make a sentence weighty.
WEIGHTY = ["urgent", "important", "deadline", "meeting", "please", "need", "must", "should"]


@query("""with p as (select doc_id, pos, trim(s) s from (select doc_id, unnest(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[.!?]+')) s, generate_subscripts(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[.!?]+'), 1) pos from documents) where trim(s) <> ''),
r as (select *, row_number() over (partition by doc_id order by len(string_split(s, ' ')) * 0.1 desc, pos) k from p)
select doc_id, md5(array_to_string(list(s order by k), '|')) sentences from r where k <= 3 group by 1""")
def key_sentences(t):
    s = X.key_sentences("text", 3, WEIGHTY)
    return t.documents.select("doc_id", s.alias("s")).where("size(s) > 0").select("doc_id", F.md5(F.array_join("s", "|")).alias("sentences"))
