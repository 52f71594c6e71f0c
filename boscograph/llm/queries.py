"""Queries of the training-data operators on the test tables, and the SQL they must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boscograph.functions.text import OTHER, STAND_INS, fold, is_stated, strip
from boscograph.llm import canonical, components, consensus, cooccurrence, mixing, neighbours, packing, scans, splitting, survivor
from boscograph.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


# 1: noise in text from scanned pages
def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repair(table(spark, sf_dir, "pdf_extracts"), "extract_id", "cleaned_text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_repaired(spark, sf_dir).select("extract_id", F.inline("damage"))


# 2: consensus from several annotators
def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "feedback")
    kind = F.when(F.col("feedback_type") == "relation_type_error", "type").when(F.col("feedback_type") == "relation_direction_error", "direction")
    said = F.when(F.col("feedback_type") == "relation_type_error", F.col("data.correct_relation")).otherwise(F.col("data.correction.correct_direction"))
    label = F.when(is_stated(said), F.regexp_replace(fold(said), "[ -]+", "_"))
    user = F.when(is_stated(F.col("user_id")), F.trim("user_id"))
    when = F.try_to_timestamp(F.regexp_replace(F.trim("timestamp"), " ", "T"))
    return consensus.latest(df, kind, F.col("item_id"), user, label, when, F.struct("received_at", "feedback_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consensus.consensus(_answers(spark, sf_dir)).labels
    best = found.groupBy("item").agg(F.max_by("label", F.struct("n_answers", "task")).alias("label"))
    return best.select(F.col("item").alias("item_id"), "label")


def p2_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consensus.consensus(_answers(spark, sf_dir))
    return found.users.withColumnRenamed("user", "user_id").withColumns({"rounds": F.lit(found.rounds), "settled": F.lit(found.settled)})


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.krippendorff(_answers(spark, sf_dir))


# 3: best representative of each duplicate group
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "merge_candidates")
    keep, category = F.col("keep"), F.col("category")
    fields = {
        "keep": (strip(keep), is_stated(keep)),
        "category": (F.lower(strip(category)), is_stated(category) & ~fold(strip(category)).isin(*OTHER)),
    }
    return survivor.survive_by_field(df, "group_id", fields, trust="confidence", recency="decided_at", tie="candidate_id")


def p3_best_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "merge_candidates")
    best = survivor.survive_whole(df, "group_id", ["entity1", "entity2", "reason", "keep", "category"], "confidence", "decided_at", "candidate_id")
    return best.select("group_id", "candidate_id", "entity1", "entity2", "keep", "category", "n_stated")


# 4: consolidating pairwise matches into groups
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "feedback").where("feedback_type = 'entity_merge'")
    names = F.array(*(F.when(is_stated(F.col(f"data.{c}")), fold(F.col(f"data.{c}"))) for c in ("entity_1", "entity_2", "canonical_name")))
    found = components.connect_rows(rows, names)
    return found.select(F.col("node").alias("entity"), F.col("root").alias("group_key"))


# 5: items that appear together
def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "relationships").select("chunk_id", F.explode(F.array("node_1", "node_2")).alias("node")).where("node is not null")
    return cooccurrence.together(rows.select("chunk_id", fold(F.col("node")).alias("item")).where("item <> ''"), "chunk_id", "item", least=8, least_lift=8)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pairs(spark, sf_dir).select("item_a", "item_b")


# 6: mapping free-entered values to the canonical list
# The categories' Chinese names.
ZH_CATEGORY = {"病原": "pathogen", "媒介": "vector", "寄主": "host", "疾病": "disease", "症状": "symptom", "地点": "location", "化合物": "compound", "防治": "treatment", "环境": "environment"}


def _category(c: Column) -> Column:
    own = fold(strip(c))
    return F.coalesce(*(F.when(own == zh, en) for zh, en in ZH_CATEGORY.items()), own)


def p6_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, terms = table(spark, sf_dir, "concepts"), table(spark, sf_dir, "ref_terms")
    return canonical.canonicalise(concepts, terms, "concept_id", "entity", _category(F.col("category")), _category(F.col("category")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_match(spark, sf_dir).where("term_id is not null and (not exact or choice)").select("concept_id", "term_id")


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_match(spark, sf_dir).where("term_id is null").select("concept_id", "entity", "choice")


# 7: most similar vectors
def p7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar(table(spark, sf_dir, "concept_vectors"), "vec_id", "vector", dim=64, k=5)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = p7_neighbours(spark, sf_dir).where("cosine >= 0.85")
    pairs = near.groupBy(F.least("vec_id", "other").alias("vec_id_a"), F.greatest("vec_id", "other").alias("vec_id_b")).agg(F.count_distinct("vec_id").alias("n"))
    return pairs.where("n = 2").select("vec_id_a", "vec_id_b")


# 8: filling fixed-capacity containers
def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", 8192)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p8_pack(spark, sf_dir), 8192)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_pack(spark, sf_dir).where("n_pieces > 1 and start = 0").select("doc_id")


# 9: mixing sources to target weights
def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    return mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "text")


def p9_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).sample()


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).fell_short()


# 10: splitting oversized items
def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(table(spark, sf_dir, "documents"), "doc_id", "text", 3000, 300)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_pieces(spark, sf_dir).where("piece_no = 1").select("doc_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_reliability, p2_agreement, p3_found, p3_best_record, p4_found, p5_found, p5_pairs, p6_found, p6_match, p6_unmatched, p7_found, p7_neighbours, p8_found, p8_pack, p8_fill, p9_found, p9_sample, p9_report, p10_found, p10_pieces)}


# The same rules said in SQL.
_SAID = ", ".join(f"'{x}'" for x in STAND_INS)


def _fold(c: str) -> str:
    return rf"lower(regexp_replace(trim({c}, ' '), ' +', ' ', 'g'))"


def _stated(c: str) -> str:
    return rf"({c} is not null and regexp_matches({c}, '[\p{{L}}\p{{N}}]') and {_fold(c)} not in ({_SAID}))"


def _best(value: str, stated: str, name: str) -> str:
    return f"select group_id, {value} as {name} from m where {stated} qualify row_number() over (partition by group_id order by confidence desc nulls last, decided_at desc nulls last, candidate_id desc) = 1"


_OTHER = ", ".join(f"'{x}'" for x in OTHER)

_PAIRS = f"""
    with i as (select distinct chunk_id as c, {_fold("n")} as e from (select chunk_id, node_1 as n from relationships union all select chunk_id, node_2 from relationships) where n is not null and chunk_id is not null),
         k as (select e, count(*) as n from i group by e), t as (select count(distinct c) as n from i),
         p as (select a.e as item_a, b.e as item_b, count(*) as n_together from i a join i b on a.c = b.c and a.e < b.e group by all having count(*) >= 8),
         f as (select item_a, item_b, n_together, x.n as n_a, y.n as n_b, t.n as n_records, n_together * t.n::double / x.n / y.n as lift from p join k x on x.e = item_a join k y on y.e = item_b, t where n_together * t.n >= 8 * x.n * y.n)
    select {{}} from f"""

SQL: dict[str, str] = {
    "p2_agreement": f"""
        with f as (select case feedback_type when 'relation_type_error' then 'type' when 'relation_direction_error' then 'direction' end as task, item_id as item, trim(user_id) as u,
                          case feedback_type when 'relation_type_error' then data.correct_relation else data.correction.correct_direction end as said, replace(trim("timestamp"), ' ', 'T') as w, received_at, feedback_id from feedback),
             a as (select task, item, u, regexp_replace({_fold("said")}, '[ -]+', '_', 'g') as label from f where task is not null and item is not null and {_stated("u")} and {_stated("said")}
                   qualify row_number() over (partition by task, item, u order by w desc, received_at desc, feedback_id desc) = 1),
             n as (select task, item, label, count(*) as c from a group by all),
             i as (select task, item, sum(c) as m, sum(c * c) as s from n group by all having sum(c) > 1),
             t as (select task, count(*) as items, sum(m) as answers, sum((m * m - s) / (m - 1)) as o from i group by task),
             q as (select task, sum(c * c) as q from (select task, label, sum(c) as c from n join i using (task, item) group by all) group by task)
        select task, items, answers::bigint as answers, o / answers as observed, (answers * answers - q) / (answers * (answers - 1)) as expected, 1 - (o / answers) / ((answers * answers - q) / (answers * (answers - 1))) as alpha from t join q using (task)""",
    "p3_found": f"""
        with m as (select * from merge_candidates where group_id is not null),
             k as ({_best("trim(keep)", _stated("keep"), "keep")}),
             c as ({_best("lower(trim(category))", _stated("category") + f" and {_fold('category')} not in ({_OTHER})", "category")})
        select g.group_id, k.keep, c.category from (select distinct group_id from m) g left join k using (group_id) left join c using (group_id)""",
    "p3_best_record": f"""
        select group_id, candidate_id, entity1, entity2, keep, category, n_stated from (
            select *, {" + ".join(f"{_stated(c)}::int" for c in ("entity1", "entity2", "reason", "keep", "category"))} as n_stated from merge_candidates where group_id is not null)
        qualify row_number() over (partition by group_id order by n_stated desc, confidence desc nulls last, decided_at desc nulls last, candidate_id desc) = 1""",
    "p4_found": f"""
        with recursive r as (select row_number() over () as i, data from feedback where feedback_type = 'entity_merge'),
             n as (select distinct i, e from (select i, {_fold("data.entity_1")} as e from r where {_stated("data.entity_1")}
                   union all select i, {_fold("data.entity_2")} from r where {_stated("data.entity_2")}
                   union all select i, {_fold("data.canonical_name")} from r where {_stated("data.canonical_name")})),
             l as (select distinct x.e as a, y.e as b from n x join n y using (i) where x.e <> y.e),
             w(a, b) as (select a, b from l union select w.a, l.b from w join l on l.a = w.b)
        select a as entity, least(a, min(b)) as group_key from w group by a""",
    "p5_found": _PAIRS.format("item_a, item_b"),
    "p5_pairs": _PAIRS.format("*"),
    "p7_found": """
        with v as (select vec_id, vector::double[] as v from concept_vectors where len(vector) = 64),
             u as (select vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from v where list_dot_product(v, v) > 0),
             t as (select a.vec_id as a, b.vec_id as b, round(list_dot_product(a.v, b.v), 9) as c from u a join u b on a.vec_id <> b.vec_id
                   qualify row_number() over (partition by a.vec_id order by c desc, b.vec_id) <= 5)
        select x.a as vec_id_a, x.b as vec_id_b from t x join t y on x.a = y.b and x.b = y.a where x.a < x.b and x.c >= 0.85""",
    "p8_found": "select doc_id from documents where strlen(text) > 8192",
    "p10_found": "select doc_id from documents where strlen(text) > 3000",
    "p9_found": f"""
        with t as (select {_fold("source")} as s, sum(coalesce(target_share, 0)) as share, max(coalesce(max_repeats, 1)) as most from mix_targets where source is not null group by 1),
             n as (select {_fold("source")} as s, sum(coalesce(strlen(text), 0)) as n from documents group by 1),
             j as (select t.*, coalesce(n, 0) as n from t left join n using (s))
        select s as source from j where most * n < share * (select sum(n) from j)""",
}
