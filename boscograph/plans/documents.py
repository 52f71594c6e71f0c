"""Queries on documents, chunks and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from boscograph.functions import cleaning as X
from boscograph.functions import vocabulary as V
from boscograph.operators import extract
from boscograph.plans import lens
from boscograph.sources import store
from boscograph.sources.tables import table

WS = r"[ \t\r\n\f\x0B\x{A0}\x{3000}]"


def _docs(s, d):
    return table(s, d, "documents")


def kg_text_clean(s, d):
    return _docs(s, d).select("doc_id", X.clean(F.col("text")).alias("clean"))


def kg_width_fold(s, d):
    return _docs(s, d).select("doc_id", X.normalise(F.col("text")).alias("folded"))


def kg_header_footer(s, d):
    own = table(s, d, "pdf_extracts").select("extract_id", F.posexplode(X.lines(F.col("cleaned_text"))).alias("i", "line"))
    return own.where(X.is_header(F.col("line"))).select("extract_id", (F.col("i") + 1).alias("line_no"), "line")


def kg_header_drop(s, d):
    return table(s, d, "pdf_extracts").where("cleaned_text is not null").select("extract_id", F.size(X.drop_headers(X.lines(F.col("cleaned_text")))).alias("lines_left"))


def kg_reference_cut(s, d):
    own = _docs(s, d).where("text is not null").select("doc_id", X.lines(F.col("text")).alias("ls"))
    return own.select("doc_id", F.size("ls").alias("lines"), F.size(X.cut_references(F.col("ls"))).alias("lines_left"))


def kg_sections(s, d):
    own = _docs(s, d).where("text is not null").select("doc_id", F.posexplode(X.sections(F.col("text"))).alias("section", "x"))
    return own.select("doc_id", "section", "x.level", "x.title", F.size("x.content").alias("n_lines"))


def kg_assembled(s, d):
    return _docs(s, d).where("text is not null").select("doc_id", F.md5(X.assemble(X.sections(F.col("text")))).alias("digest"))


def kg_sentences(s, d):
    own = _docs(s, d).where("text is not null").select("doc_id", X.sentences(F.col("text")).alias("x"))
    return own.select("doc_id", F.size("x").alias("n_sentences"), F.coalesce(F.array_max(F.transform("x", F.length)), F.lit(0)).alias("longest"))


def kg_sentence_filter(s, d):
    own = _docs(s, d).where("text is not null").select("doc_id", X.basic_sentences(F.col("text"), 10, 500).alias("x"))
    return own.select("doc_id", F.size("x").alias("n_kept"))


def kg_clean_summary(s, d):
    c = X.clean(F.col("text"))
    own = _docs(s, d).where("text is not null").select("doc_id", "text", c.alias("c"))
    return own.select("doc_id", F.size(F.split("text", "\n")).alias("lines_before"), F.size(F.split("c", "\n")).alias("lines_after"), F.length("text").alias("chars_before"), F.length("c").alias("chars_after"))


def kg_chunks(s, d):
    own = _docs(s, d).select("doc_id", F.explode(X.windows(F.col("text"))).alias("x"))
    return own.select("doc_id", F.col("x.no").alias("window_no"), F.length("x.text").alias("n_chars"), F.md5("x.text").alias("digest"))


def kg_chunk_papers(s, d):
    own = table(s, d, "concepts").where("chunk_id is not null").select(X.paper_of(F.col("chunk_id")).alias("paper"), "chunk_id")
    return own.groupBy("paper").agg(F.count_distinct("chunk_id").alias("n_chunks"), F.count("*").alias("n_concepts"))


def kg_snippets(s, d):
    own = _docs(s, d).where("text is not null").select("doc_id", F.posexplode(X.snippets(F.col("text"), F.lit("infection"), 20)).alias("no", "snippet"))
    return own.select("doc_id", "no", F.md5("snippet").alias("digest"))


def kg_chinese(s, d):
    return _docs(s, d).where("text is not null").groupBy(X.has_chinese(F.col("text")).alias("chinese"), "lang").agg(F.count("*").alias("n"))


def kg_table_sentences(s, d):
    head = F.array(*(F.lit(x) for x in ("来源", "目标份额", "重复")))
    row = F.array(F.col("source"), F.format_number("target_share", 2), F.col("max_repeats").cast("string"))
    return table(s, d, "mix_targets").select("source", F.array_join(X.table_sentences(head, F.array(row)), "").alias("sentence"))


def kg_content_hash(s, d):
    own = _docs(s, d).where("text is not null")
    return own.groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def kg_incremental_resume(s, d):
    """Chunks with relations that no concept was taken from yet."""
    have = table(s, d, "relationships").where("chunk_id is not null").select("chunk_id").distinct()
    return store.unprocessed(have, table(s, d, "concepts").where("chunk_id is not null"))


def kg_json_extract(s, d):
    c = table(s, d, "concepts").where("chunk_id is not null")
    one = F.struct(F.struct("entity", F.col("importance").cast("string").alias("importance"), "category").alias("c"))
    answers = c.select(F.concat_ws("#", "chunk_id", F.col("concept_id").cast("string")).alias("chunk_id"), F.to_json(F.struct(F.array(one.getField("c")).alias("concepts"))).alias("answer"))
    return extract.concepts_of(answers).select("chunk_id", "entity", "importance", "category")


def _placed(s, d):
    c = lens.concepts(s, d).where("chunk_id is not null")
    return c.select(X.paper_of(F.col("chunk_id")).alias("paper"), F.regexp_extract("chunk_id", "_([0-9]+)$", 1).try_cast("int").alias("chunk_no"), "chunk_id", "ord", "entity", "importance").where("chunk_no is not null")


def kg_context_window(s, d):
    return extract.recent_entities(_placed(s, d))


def kg_context_window_exact(s, d):
    return extract.context_window(_placed(s, d)).select("chunk_id", F.array_join("context", "|").alias("context"))


def kg_rule_critic(s, d):
    c, r = extract.critic(lens.concepts(s, d), lens.edges(s, d))
    a = c.groupBy("approved").agg(F.count("*").alias("n")).select(F.lit("concept").alias("what"), "approved", "n")
    return a.unionByName(r.groupBy("approved").agg(F.count("*").alias("n")).select(F.lit("relation").alias("what"), "approved", "n"))


def kg_rule_refine(s, d):
    c, r = extract.refine(*extract.critic(lens.concepts(s, d), lens.edges(s, d)))
    return c.agg(F.count("*").alias("concepts"), F.count_distinct("entity").alias("entities")).crossJoin(r.agg(F.count("*").alias("relations")))  # two single rows


def kg_mentions(s, d):
    """Listed terms that the texts mention: the default extractor."""
    found = extract.dictionary_mentions(_docs(s, d), "doc_id", "text", table(s, d, "ref_terms").select("term"))
    return found.groupBy("term").agg(F.count("*").alias("n_docs"))


def kg_progress(s, d):
    c = table(s, d, "concepts").where("chunk_id is not null").agg(F.count_distinct("chunk_id").alias("chunks"), F.count("*").alias("concepts"))
    r = table(s, d, "relationships").where("chunk_id is not null").agg(F.count("*").alias("relationships"), F.min("extracted_at").alias("a"), F.max("extracted_at").alias("b"))
    j = c.crossJoin(r)  # two single rows
    return j.select("chunks", "concepts", "relationships", F.round(F.timestamp_diff("SECOND", "a", "b") / 60.0 / F.col("chunks"), 6).alias("minutes_per_chunk"), F.round(F.col("chunks") * 92 / 60.0, 6).alias("estimated_minutes"))


def kg_image_retrieval(s, d):
    links = lens.edges(s, d).where("chunk_id is not null").select(F.col("src").alias("concept"), F.col("chunk_id").alias("image_path"), F.col("dst").alias("caption"))
    links = links.groupBy("concept", "image_path").agg(F.min("caption").alias("caption"))
    return extract.images_for(links, ["Scarlet Needle Scorch", "paroum avivamula", "no such concept"], 3)


def kg_illustrations(s, d):
    img = lens.edges(s, d).where("chunk_id is not null").select(F.col("src").alias("entity"), F.col("chunk_id").alias("image_path"), F.concat_ws(" ", "src", "edge", "dst").alias("caption"))
    return extract.illustrations(img, lens.concepts(s, d)).groupBy("concept", "relationship_type").agg(F.count("*").alias("n"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("kg_")}

_STRIP = lambda c: rf"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"
_CLEAN = _STRIP(r"regexp_replace(replace(replace(regexp_replace(text, '[\x00-\x08\x0b-\x0c\x0e-\x1f]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")
_PAIRS = ",".join(f"('{w}')" for w in extract.VALID_RELATIONS)
_HEAD = "(?i)" + "|".join(f"(?:{p})" for p in V.HEADER_PATTERNS)
_WORDS = " or ".join(f"contains(s, '{w}')" for w in V.HEADER_WORDS)
_REF = V.REFERENCE_PATTERN + "|" + "|".join(V.REFERENCE_WORDS)
_IN_TABLE = " or ".join(f"contains(coalesce(edge, ''), '{w}')" for w in extract.VALID_RELATIONS)
_CATS = ",".join(f"'{c}'" for c in extract.VALID_CATEGORIES)

_WIDE = X._WIDE.replace("'", "''")
_NARROW = X._NARROW.replace("'", "''")

SQL = {
    "kg_sentences": r"""
        with t as (select doc_id, trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g'), ' ') as t from documents where text is not null),
             p as (select doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([。！？!?；;.]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: length(x) >= 5) as x from t)
        select doc_id, len(x)::int as n_sentences, coalesce(list_max(list_transform(x, lambda y: length(y))), 0)::int as longest from p""",
    "kg_width_fold": rf"select doc_id, trim(regexp_replace(regexp_replace(translate(text, '{_WIDE}', '{_NARROW}'), '[\s\x0B\x{{A0}}\x{{3000}}]+', ' ', 'g'), '[\x00-\x1f\x7f-\x{{9f}}]', '', 'g'), ' ') as folded from documents",
    "kg_text_clean": f"select doc_id, {_CLEAN} as clean from documents",
    "kg_header_footer": f"""
        with l as (select extract_id, unnest(string_split(cleaned_text, chr(10))) as line, generate_subscripts(string_split(cleaned_text, chr(10)), 1) as i from pdf_extracts where cleaned_text is not null),
             x as (select *, {_STRIP("line")} as s from l)
        select extract_id, i::int as line_no, line from x where length(s) between 5 and 50 and (regexp_matches(s, '{_HEAD}') or {_WORDS})""",
    "kg_header_drop": f"""
        with l as (select extract_id, unnest(string_split(cleaned_text, chr(10))) as line from pdf_extracts where cleaned_text is not null), x as (select extract_id, {_STRIP("line")} as s from l)
        select extract_id, (count(*) filter (where s <> '' and not (length(s) between 5 and 50 and (regexp_matches(s, '{_HEAD}') or {_WORDS}))))::int as lines_left from x group by extract_id""",
    "kg_reference_cut": f"""
        with l as (select doc_id, len(string_split(text, chr(10))) as n, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents where text is not null)
        select doc_id, any_value(n)::int as lines, coalesce(min(i) filter (where i >= 0.8 * n and regexp_matches(line, '{_REF}')), any_value(n))::int as lines_left from l group by doc_id""",
    "kg_clean_summary": f"""
        with x as (select doc_id, text, {_CLEAN} as c from documents where text is not null)
        select doc_id, len(string_split(text, chr(10)))::int as lines_before, len(string_split(c, chr(10)))::int as lines_after, length(text)::int as chars_before, length(c)::int as chars_after from x""",
    "kg_chunks": f"""
        with s as (select doc_id, text, unnest(range(0, length(text), 2700)) as p from documents where length(text) > 0), w as (select doc_id, (p / 2700)::int as window_no, substr(text, p + 1, 3000) as t from s)
        select doc_id, window_no, length(t)::int as n_chars, md5(t) as digest from w where length({_STRIP("t")}) > 50""",
    "kg_chunk_papers": "select regexp_replace(chunk_id, '_[0-9]+$', '') as paper, count(distinct chunk_id) as n_chunks, count(*) as n_concepts from concepts where chunk_id is not null group by 1",
    "kg_chinese": "select regexp_matches(text, '[\\x{4e00}-\\x{9fa5}]') as chinese, lang, count(*) as n from documents where text is not null group by all",
    "kg_table_sentences": "select source, '来源为' || source || '；目标份额为' || printf('%.2f', target_share) || '；重复为' || max_repeats || '。' as sentence from mix_targets",
    "kg_content_hash": "select md5(text) as hash, count(*) as n, min(doc_id) as first_doc from documents where text is not null group by 1 having count(*) > 1",
    "kg_incremental_resume": "select distinct chunk_id from relationships where chunk_id is not null and chunk_id not in (select chunk_id from concepts where chunk_id is not null)",
    "kg_json_extract": "select chunk_id || '#' || concept_id as chunk_id, lower(trim(entity, ' ')) as entity, greatest(1, least(5, coalesce(importance, 3)))::int as importance, lower(coalesce(category, 'misc')) as category from concepts where chunk_id is not null and trim(entity, ' ') <> ''",
    "kg_context_window": f"""
        with {lens.C}, p as (select regexp_replace(chunk_id, '_[0-9]+$', '') as paper, try_cast(regexp_extract(chunk_id, '_([0-9]+)$', 1) as int) as chunk_no, chunk_id, entity, importance from c where chunk_id is not null),
             k0 as (select distinct paper, chunk_no, chunk_id from p where chunk_no is not null),
             k as (select *, row_number() over (partition by paper order by chunk_no, chunk_id) as r from k0),
             w as (select distinct k.chunk_id, p.entity from k join k as b on b.paper = k.paper and b.r between k.r - 3 and k.r - 1 join p on p.chunk_id = b.chunk_id and p.importance >= 4)
        select k.chunk_id, coalesce((select string_agg(entity, '|' order by entity) from w where w.chunk_id = k.chunk_id), '') as context from k""",
    "kg_rule_critic": f"""
        with {lens.C}, {lens.E} select 'concept' as what, coalesce(lower(category) in ({_CATS}), false) as approved, count(*) as n from c group by all
        union all select 'relation', ({_IN_TABLE}), count(*) from e group by all""",
    "kg_rule_refine": f"""
        with {lens.C}, {lens.E} select (select count(*) from c where lower(category) in ({_CATS})) as concepts, (select count(distinct entity) from c where lower(category) in ({_CATS})) as entities, (select count(*) from e where {_IN_TABLE}) as relations""",
    "kg_mentions": "select lower(r.term) as term, count(*) as n_docs from (select distinct lower(term) as term from ref_terms) r join documents d on contains(lower(d.text), r.term) group by 1",
    "kg_progress": """
        with c as (select count(distinct chunk_id) as chunks, count(*) as concepts from concepts where chunk_id is not null),
             r as (select count(*) as relationships, min(extracted_at) as a, max(extracted_at) as b from relationships where chunk_id is not null)
        select chunks, concepts, relationships, round(date_sub('second', a, b) / 60.0 / chunks, 6) as minutes_per_chunk, round(chunks * 92 / 60.0, 6) as estimated_minutes from c, r""",
    "kg_image_retrieval": f"""
        with {lens.E}, l as (select src as concept, chunk_id as image_path, min(dst) as caption from e where chunk_id is not null group by all),
             a(c, i) as (values ('scarlet needle scorch', 0), ('paroum avivamula', 1), ('no such concept', 2)),
             x as (select l.*, i, row_number() over (partition by c order by image_path) as n from l join a on l.concept = a.c qualify n <= 3)
        select concept, image_path, caption from x qualify row_number() over (partition by image_path order by i, n) = 1""",
    "kg_illustrations": f"""
        with {lens.E}, {lens.C} select src as concept, 'ILLUSTRATED_BY' as relationship_type, count(*) as n from e where chunk_id is not null and length(concat_ws(' ', src, edge, dst)) >= 10 and src in (select entity from c) group by all""",
}
